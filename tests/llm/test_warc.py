"""Archives: what is written is read back, transactions meet, copies become revisits."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from parley.llm import warc
from parley.session import shared_dir


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


PAGES = [
    (1, "http://a.example/x", "<p>one</p>"),
    (2, "http://a.example/y", "<p>one</p>"),
    (3, "http://b.example/", "<p>one</p>"),
    (4, "http://b.example/z", ""),
    (5, "http://b.example/z", None),
    (6, None, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (7, "http://ü.example/line\nbreak", "é\r\n\r\n\n\x00 end\r\n" * 50),
    (8, "http://c.example/long", "<div>" + "word " * 60_000),
    (9, "http://c.example/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
]


def frame(spark, rows):
    rows = [(*r, "u", 5) for r in rows]
    return spark.createDataFrame(
        rows, "page_id long, url string, html string, record_type string, payload_bytes int"
    )


def wanted(rows, min_bytes=0):
    texts = {i: h or "" for i, _, h in rows if i is not None}
    out = []
    for i, t in texts.items():
        size = len(t.encode())
        last = max(j for j, u in texts.items() if u == t) if size >= min_bytes else i
        kind = "response" if last == i else "revisit"
        out.append((i, size, sha(t), kind, None if last == i else last))
    return sorted(out)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("min_bytes", [0, 1, 20])
def test_round_trip(spark, min_bytes):
    got = warc.captures(frame(spark, PAGES), min_bytes=min_bytes).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == wanted(PAGES, min_bytes)


def test_transactions_are_whole(spark):
    rows = warc.captures(frame(spark, PAGES)).collect()
    assert len(rows) == len(PAGES)
    for row in rows:
        request, answer, meta = row.capture.request, row.capture.response, row.capture.metadata
        assert request.record_type == "request" and meta.record_type == "metadata"
        assert answer.record_type in ("response", "revisit")
        assert f"page-id: {row.page_id}" in meta.head
        assert answer.stated_digest == row.payload_digest


def test_null_and_repeated_ids(spark):
    """A record and a row for every page row; the largest id, then the greatest URL, is the response."""
    rows = [
        *PAGES, (None, "http://n/", "x"), (None, "http://n/", "x"), (None, "http://m/", "<p>one</p>"), (None, None, None),
        (3, "http://a.example/x", "<p>one</p>"), (4, "http://z/", ""), (20, "u", "twice"), (20, "u", "twice"), (20, "u", "other"),
    ]
    got = warc.captures(frame(spark, rows)).select(*COLUMNS, "url").collect()
    assert len(got) == len(rows)
    assert sorted((str(r.page_id), r.payload_digest) for r in got) == sorted((str(i), sha(h or "")) for i, _, h in rows)
    by = {}
    for r in got:
        by.setdefault(r.payload_digest, []).append(r)
    for digest, own in by.items():
        ids = [r.page_id for r in own if r.page_id is not None]
        (answer,) = [r for r in own if r.record_type == "response"]
        assert answer.page_id == max(ids, default=None) and answer.refers_to is None
        assert all(r.record_type == "revisit" and r.refers_to == answer.page_id for r in own if r is not answer)
    assert [r.url for r in by[sha("<p>one</p>")] if r.record_type == "response"] == ["http://b.example/"]


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "SMALL", 1000)
    rows = [(i, "u", chr(97 + i % 26) * (i * 37 % 900)) for i in range(150)] + [(1000 + i, "u", str(i) * 9000) for i in range(10)]
    place = str(tmp_path / "out")
    warc.write(frame(spark, rows).coalesce(1), place)
    sizes = [len(warc.unpacked(p.read_bytes())) for p in (tmp_path / "out").rglob("*.gz")]
    assert len(sizes) > 8 and max(sizes) < 40_000 + 150 * 1200
    big = [s for s in sizes if s > 30_000]
    assert all(s < 90_000 for s in big)
    answers = warc.read(spark, place).where("record_type in ('response', 'revisit')")
    assert answers.count() == 160


def test_no_pages(spark):
    assert warc.captures(frame(spark, PAGES).limit(0)).collect() == []


def test_foreign_archive(spark, tmp_path):
    """Members packed one by one, headers in any case, a response that names its request."""

    def member(kind, name, block, *more):
        lines = ["WARC/1.0", f"warc-type: {kind}", f"WARC-RECORD-ID: {name}", *more]
        head = "\r\n".join([*lines, f"content-length: {len(block)}", "", ""]).encode()
        return head + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    parts = [
        member("warcinfo", "<i>", b"software: x\r\n"),
        member("request", "<q>", b"GET / HTTP/1.1\r\n\r\n"),
        member("response", "<r>", http, "WARC-Concurrent-To: <q>"),
        member("metadata", "<m>", b"k: v\r\n", "WARC-Concurrent-To: <q>"),
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (folder / "b.warc").write_bytes(member("response", "<s>", http))
    rows = {r.capture_id: r for r in warc.assemble(warc.read(spark, str(folder))).collect()}
    assert set(rows) == {"<r>", "<s>"}
    assert rows["<r>"].request.record_id == "<q>" and rows["<r>"].metadata.record_id == "<m>"
    assert rows["<r>"].response.payload_bytes == 4 and rows["<s>"].request is None


def test_broken_archives():
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(b"hello"))


def test_hot_payload_is_dealt_in_parts(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("same").alias("html")
    )
    got = warc.captures(rows)
    assert got.where("record_type = 'response'").select("page_id").collect()[0][0] == 2999
    assert got.where("refers_to = 2999").count() == 2999
    assert shared_dir(spark)
