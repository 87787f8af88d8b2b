"""The prefix trie against one built from Python tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from parley.llm import prefixes

SCHEMA = "conv_id long, turn int, role string, text string, node string, depth string, shard string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def by_hand(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0), tie, (role, text)))
    convs = {c: [t for *_, t in sorted(turns)] for c, turns in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = convs.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below if n)
        text = ",".join(map(str, sorted(ends[node])))
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own),
            sum(len(n) == len(node) + 1 for n in below), len(leaves), saved, hashlib.sha256(text.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def built(spark, rows, parts=6):
    frame = spark.createDataFrame([(*r, "n", "d", "s") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in prefixes.trie(frame).select(*COLUMNS).collect()), key=str)


def dialogues(rnd, n, turns):
    rows = []
    for _ in range(n):
        conv = rnd.randrange(120)
        for turn in range(rnd.randrange(turns)):
            rows.append((conv, turn, rnd.choice(["user", "assistant"]), rnd.choice(["a b", "c", "", "d e f"])))
    return rows


@pytest.mark.parametrize("limit, band, held", [(10_000, 4096, 100_000), (4, 3, 2), (1, 1, 1), (10_000, 2, 1)])
def test_random_dialogues(spark, monkeypatch, limit, band, held):
    monkeypatch.setattr(prefixes, "LIMIT", limit)
    monkeypatch.setattr(prefixes, "BAND", band)
    monkeypatch.setattr(prefixes, "HELD", held)
    monkeypatch.setattr(prefixes, "CHUNK", 5)
    rows = dialogues(random.Random(1), 70, 7)
    assert built(spark, rows) == by_hand(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", "tie"), (1, 0, "", "tie"), (1, 5, "user", " \t x\x0by "),
        (None, 0, "user", "lost"), (0, 0, "user", "base"), (0, None, "user", "earlier"), (2, 7, "user", ""),
        (-3, 0, "user", "minus"), (45, 1, "user", "no base"), (45, 2, "é", "ü " * 50_000), (1000, 0, "a:", "b"), (1001, 0, "a", ":b"),
    ]
    want = by_hand([r for r in rows if r[0] != -3])
    assert built(spark, [r for r in rows if r[0] != -3]) == want
    assert len(built(spark, rows)) >= len(want)


def test_empty_table(spark):
    assert built(spark, []) == [] and built(spark, [(None, 1, "user", "x")]) == []


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    """A long conversation and its copies: torn by the partitions, cut into bands."""
    monkeypatch.setattr(prefixes, "BAND", 16)
    rows = [(c, t, "user", f"turn {t % 3}") for c in (20, 21, 22, 23) for t in range(150)]
    rows += [(c, t, "user", "short") for c in range(40, 60) for t in range(3)]
    assert built(spark, rows, 8) == by_hand(rows)


def test_sql(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet')")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({prefixes.ORACLE})").fetchall()
    frame = spark.read.parquet(f"{folder}/conversations.parquet")
    got = [tuple(r) for r in prefixes.trie(frame).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_queue_spills():
    rnd = random.Random(2)
    items = [(rnd.randrange(50), bytes([rnd.randrange(5)]), i, 0) for i in range(500)]
    queue = prefixes.Queue(7)
    for item in items:
        queue.push(item)
    assert queue.runs and len(queue.heap) <= 7
    out = []
    while queue.least() is not None:
        assert queue.least() == (item := queue.pop())
        out.append(item)
    assert out == sorted(items)
