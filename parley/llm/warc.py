"""WARC archives: writing captures, reading records, and putting transactions together.

A capture is written as three records: the request, the response (or, where the payload was
captured before, a revisit that refers to it), and metadata. Archives are gzip text files made
by Spark's own writer: a record ends in two line ends, the writer adds the second one, so files
are committed as any Spark output is and may lie in any store.

Records are read back by their content lengths, whatever the payload holds. Request and
metadata records name the response they belong to (``WARC-Concurrent-To``), directly or through
one record between, or are named by it; the transaction is put together by joins on these
identifiers, with headers only, and one nested row per capture comes out.

Rows: every page row gives one capture, rows without an id and rows that repeat an id too. Records are
named by id, URL, payload digest and, among equal rows, a number; the id itself, null included, stands in the
metadata. A null payload counts as empty, a null URL as an empty target. Of equal payloads the row with the
largest id is the response (a null id is the least; of equal ids the greatest URL). Equal payloads are told by
SHA-1 and length. Columns other than id, url and payload are ignored. An empty table gives an empty result.

Files are bounded by bytes, since one task reads a file: rows are written by classes of payload size, of the large
ones few to a file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import map_rows
from parley.session import shared_dir, stage

LINE = "\r\n"
FILE_BYTES = 1 << 26  # payload bytes of one archive file at most, but for a single page
SMALL = 1 << 15  # payload bytes of the first class of pages; each further class has four times more
DATE = "2024-01-01T00:00:00Z"  # records get one date, so that archives are reproducible
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPREAD = 16  # parts into which the rows of one payload are dealt


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def identifier(kind: str, key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{key}')}>"


def record(headers: dict[str, str], block: str) -> str:
    """A record without its last line end, which the file writer adds."""
    size = len(block.encode("utf-8", "surrogatepass"))
    lines = [f"{k}: {' '.join(v.split())}" for k, v in {**headers, "Content-Length": str(size)}.items()]
    return LINE.join(["WARC/1.1", *lines, "", block]) + LINE


def originals(slim: DataFrame, min_bytes: int) -> DataFrame:
    """Which captures revisit another: ``name, original``, the largest key of equal payloads."""
    order = F.struct("key", "url", (-F.col("copy")).alias("turn"), "name")
    repeated = (
        slim.where(F.col("size") >= min_bytes)
        .groupBy("sha", "size")
        .agg(F.max(order).alias("top"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha", "size", F.col("top.name").alias("original"))
    )
    # rows of one payload meet it in several parts, so none gathers them all
    dealt = repeated.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    parted = slim.withColumn("part", F.pmod(F.hash("name"), F.lit(SPREAD)))
    return (
        parted.join(dealt, ["sha", "size", "part"])
        .where("name <> original")
        .select("name", "original")
    )


def _named(rows: DataFrame) -> DataFrame:
    """Rows with ``name``, different for all rows that differ in key, URL, digest or copy."""
    key = F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit(""))
    return rows.withColumn("name", F.sha1(F.to_json(F.struct(key.alias("k"), "url", "sha", "copy"))))


def _copies(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Equal rows told apart by ``copy``: one of them is kept and repeated with its numbers."""
    met = rows.alias("r").join(
        repeated.alias("m"),
        F.expr("r.key <=> m.key and r.url = m.url and r.sha = m.sha and r.size = m.size"),
        "left",
    ).select("r.*", "m.n")
    once = met.where("n is null").drop("n").withColumn("copy", F.lit(0))
    many = met.where("n is not null").dropDuplicates(["key", "url", "sha", "size"])
    every = F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("copy")
    return once.unionByName(many.select(*rows.columns, every))


def write(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
) -> None:
    """Write request, response or revisit, and metadata records of every capture."""
    source = pages.select(
        pages[id_col].alias("key"),
        F.coalesce(pages[url_col], F.lit("")).alias("url"),
        F.coalesce(pages[payload_col], F.lit("")).alias("payload"),
    )
    source = source.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    facts = source.groupBy("key", "url", "sha", "size").agg(F.count("*").alias("n"))
    facts = stage(facts)
    every = F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("copy")
    slim = stage(_named(facts.select("key", "url", "sha", "size", every)))
    repeated = facts.where("n > 1")
    source = source.withColumn("copy", F.lit(0)) if repeated.isEmpty() else _copies(source, repeated)
    revisits = stage(originals(slim, min_bytes))
    captures = _named(source).select("key", "url", "payload", "size", "name").join(revisits, "name", "left")

    def make():
        def work(rows):
            for name, key, url, payload, original in zip(
                *(rows[c] for c in ("name", "key", "url", "payload", "original"))
            ):
                yield from ((r,) for r in capture(name, key, url, payload, original))

        return work

    # class c holds payloads below SMALL * 4 ** c bytes; a size needs a handful of classes
    bits = F.greatest(F.ceil(F.log2((F.col("size") + 1) / SMALL) / 2), F.lit(0)).cast("int")
    classes = [row["c"] for row in slim.select(bits.alias("c")).distinct().collect()]
    for c in sorted(classes) or [0]:
        most = max(1, FILE_BYTES // (SMALL << 2 * c))
        (
            map_rows(captures.where(bits == c).drop("size"), "value string", make)
            .write.option("lineSep", LINE)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", 3 * most)
            .text(f"{path}/class-{c}")
        )


def capture(name: str, key: object, url: str, payload: str, original: str | None) -> Iterator[str]:
    """The three records of one capture, named after it; ``original`` names the one it revisits."""
    raw = payload.encode("utf-8", "surrogatepass")
    shared = {"WARC-Date": DATE, "WARC-Target-URI": url}
    own = identifier("response", name)
    host, _, rest = url.partition("://")[2].partition("/")
    yield record(
        {
            "WARC-Type": "request",
            "WARC-Record-ID": identifier("request", name),
            "WARC-Concurrent-To": own,
            **shared,
            "Content-Type": "application/http;msgtype=request",
        },
        LINE.join((f"GET /{' '.join(rest.split())} HTTP/1.1", f"Host: {' '.join(host.split())}", "", "")),
    )
    http = LINE.join(
        ("HTTP/1.1 200 OK", "Content-Type: text/html;charset=utf-8", f"Content-Length: {len(raw)}", "", "")
    )
    headers = {
        "WARC-Type": "response" if original is None else "revisit",
        "WARC-Record-ID": own,
        **shared,
        "WARC-Payload-Digest": "sha1:" + digest(raw),
        "Content-Type": "application/http;msgtype=response",
    }
    if original is None:
        yield record(headers, http + payload)
    else:
        headers["WARC-Profile"] = REVISIT_PROFILE
        headers["WARC-Refers-To"] = identifier("response", original)
        yield record(headers, http)
    yield record(
        {
            "WARC-Type": "metadata",
            "WARC-Record-ID": identifier("metadata", name),
            "WARC-Concurrent-To": identifier("request", name),
            **shared,
            "Content-Type": "application/warc-fields",
        },
        f"page-id: {quote_plus(str(key))}{LINE}" if key is not None else f"page-id-missing: true{LINE}",
    )


def unpacked(content: bytes) -> bytes:
    """The bytes of a file, of all its gzip members if it is packed."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(parts)


def parse(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers, by lower-case name, and block of every record of an archive."""
    content, at = unpacked(content), 0
    while at < len(content):
        if content.startswith(b"\r\n", at):
            at += 2
            continue
        if not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"headers that do not end, at byte {at}")
        headers: dict[str, list[str]] = {}
        for line in content[at:end].split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        if end + 4 + size > len(content):
            raise ValueError(f"a block that is cut short, at byte {at}")
        yield headers, content[end + 4 : end + 4 + size]
        at = end + 4 + size


def http_payload(block: bytes) -> tuple[bytes, bytes]:
    """Head and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return head, body


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; the block of responses only as size and digest of the payload."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")

    def make():
        def work(rows):
            for content in rows["content"]:
                for headers, block in parse(content):
                    first = {k: v[0] for k, v in headers.items()}
                    kind = first.get("warc-type")
                    head, body = http_payload(block) if kind in ("response", "revisit") else (block, b"")
                    yield (
                        first.get("warc-record-id"),
                        kind,
                        first.get("warc-target-uri"),
                        headers.get("warc-concurrent-to", []),
                        first.get("warc-refers-to"),
                        (first.get("warc-payload-digest") or ":").partition(":")[2] or None,
                        len(body) if kind == "response" else None,
                        digest(body) if kind == "response" else None,
                        head.decode("utf-8", "replace"),
                    )

        return work

    return map_rows(
        files,
        "record_id string, record_type string, url string, concurrent_to array<string>, "
        "refers_to string, stated_digest string, payload_bytes bigint, found_digest string, "
        "head string",
        make,
    )


def _fields() -> Column:
    return F.struct("record_id", "record_type", "url", "refers_to", "stated_digest",
                    "payload_bytes", "found_digest", "head")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, request, metadata``.

    Request and metadata records are grouped under the response they are concurrent to.
    """
    answers = records.where(F.col("record_type").isin("response", "revisit"))
    others = records.where(~F.col("record_type").isin("response", "revisit"))
    names = answers.select(F.col("record_id").alias("to"))
    links = (
        others.select("record_id", F.explode("concurrent_to").alias("to"))
        .unionByName(
            answers.select(
                F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("to")
            )
        )
        .distinct()
    )
    direct = links.join(names, "to").select("record_id", F.col("to").alias("answer"))
    between = direct.withColumnRenamed("record_id", "to")
    onward = links.join(names, "to", "left_anti").join(between, "to")
    placed = direct.unionByName(onward.select("record_id", "answer")).distinct()
    slim = _fields().alias("record")
    members = (
        others.select("record_id", slim)
        .join(placed, "record_id")
        .select(F.col("answer").alias("capture_id"), "record")
        .unionByName(answers.select(F.col("record_id").alias("capture_id"), slim))
    )
    kind = F.col("record.record_type")
    return members.groupBy("capture_id").agg(
        F.max(F.when(kind.isin("response", "revisit"), F.col("record"))).alias("response"),
        F.max(F.when(kind == "request", F.col("record"))).alias("request"),
        F.max(F.when(kind == "metadata", F.col("record"))).alias("metadata"),
    )


def resolve(captures: DataFrame) -> DataFrame:
    """Captures with the payload size and digest of the response they revisit."""
    own = captures.withColumns(
        {
            "payload_bytes": F.col("response.payload_bytes"),
            "payload_digest": F.coalesce("response.found_digest", "response.stated_digest"),
            "refers_to": F.col("response.refers_to"),
        }
    )
    line = r"(?m)^page-id: (.*?)\r?$"
    told = F.regexp_like("metadata.head", F.lit(line))
    page = F.when(told, F.url_decode(F.regexp_extract("metadata.head", line, 1)))
    own = own.withColumn("page", page)
    seen = own.where("refers_to is not null").select(F.col("refers_to").alias("capture_id"))
    targets = own.join(seen.distinct(), "capture_id", "left_semi").select(
        F.col("capture_id").alias("refers_to"),
        F.col("payload_bytes").alias("target_bytes"),
        F.col("page").alias("target_page"),
        F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"),
    )
    parted = own.withColumn("part", F.pmod(F.hash("capture_id"), F.lit(SPREAD)))
    return (
        parted.join(targets, ["refers_to", "part"], "left")
        .withColumn("payload_bytes", F.coalesce("payload_bytes", "target_bytes"))
        .drop("part", "target_bytes")
    )


def captures(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
) -> DataFrame:
    """Write pages as archives in the shared folder, read them back, one row per capture."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, id_col, url_col, payload_col, min_bytes)
    # headers are read once; three joins use them
    found = resolve(stage(assemble(stage(read(spark, path)))))
    kind = pages.schema[id_col].dataType.simpleString()
    return found.select(
        F.expr(f"try_cast(page as {kind})").alias(id_col),
        "payload_bytes",
        "payload_digest",
        F.col("response.record_type").alias("record_type"),
        F.expr(f"try_cast(target_page as {kind})").alias("refers_to"),
        F.col("response.url").alias("url"),
        F.struct("request", "response", "metadata").alias("capture"),
    )
