"""The token-group join against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from parley.llm import groupjoin

SCHEMA = "doc_id long, text string, sid int, key string, group string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "g") for r in rows], SCHEMA)


def shingles(text, words=3):
    parts = (text or "").encode().lower().split()
    size = min(words, len(parts))
    return frozenset(tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)) if parts else frozenset()


def by_hand(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if None in (rows[i][0], rows[j][0]) or not a or not b:
            continue
        if rows[i][0] == rows[j][0] or 100 * len(a & b) >= percent * len(a | b):
            above[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((k, len(sets[i]), None if k is None else least[root(i)]) for i, (k, _) in enumerate(rows)), key=str)


def check(spark, rows):
    got = groupjoin.components_of(frame(spark, rows).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(rows)


def variants(rnd, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
        yield " ".join(words)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one\x0btwo"),
        (8, "one two three"), (9, "ONE two\nthree"), (None, "one two three"), (None, None),
        (10, "Ä two three"), (11, "ä two three"), (12, "x y z"), (12, "p q r"), (13, "p q r"),
        (14, "a b c"), (14, "a b c"), (15, "long " * 30_000), (16, "long " * 40_000),
    ]
    check(spark, rows)


def test_empty_table(spark):
    empty = frame(spark, [])
    got = groupjoin.components_of(empty)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == 0
    assert groupjoin.components_of(frame(spark, [(1, None), (2, "")])).count() == 2


def test_pairs_at_the_threshold(spark):
    # 21 tokens, 19 in common, and one more or less
    base = [f"w{i}" for i in range(200)]
    rows = []
    for n, cut in enumerate(range(0, 30)):
        rows.append((2 * n, " ".join(f"{n}{w}" for w in base)))
        rows.append((2 * n + 1, " ".join(f"{n}{w}" for w in base[: len(base) - cut])))
    check(spark, rows)


def test_families(spark, monkeypatch):
    rnd = random.Random(3)
    rows, key = [], 0
    for f in range(12):
        base = [f"f{f}w{rnd.randrange(500)}" for _ in range(rnd.randrange(4, 160))]
        for text in variants(rnd, base, rnd.randrange(1, 40), 5):
            rows.append((key, text))
            key += 1
    rnd.shuffle(rows)
    check(spark, rows)
    monkeypatch.setattr(groupjoin, "GROUP", 8)  # crowded groups, several blocks
    monkeypatch.setattr(groupjoin, "QUERIES", 3)
    check(spark, rows)


def test_links_that_signatures_miss(spark, monkeypatch):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = list(enumerate(variants(rnd, base, 150, 7)))
    monkeypatch.setattr(groupjoin, "TREES", 1)
    monkeypatch.setattr(groupjoin, "KEY", 8)  # hardly any two signatures meet in a bucket
    check(spark, rows)
    monkeypatch.setattr(groupjoin, "LOOSE", 33)  # nothing is linked inside a group
    check(spark, rows)


def test_common_tokens(spark):
    rnd = random.Random(5)
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(i, f"{line} " + " ".join(f"r{rnd.randrange(60)}" for _ in range(rnd.randrange(0, 6)))) for i in range(200)]
    check(spark, rows)


def test_a_crowded_family(spark):
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    texts = list(variants(rnd, base, 3000, 2))
    got = groupjoin.components_of(frame(spark, list(enumerate(texts))))
    counts = sorted(r["n"] for r in got.groupBy("component_id").agg(F.count("*").alias("n")).collect())
    sets = [shingles(t) for t in texts]
    whole = shingles(" ".join(base))
    near = sum(100 * len(s & whole) >= 90 * len(s | whole) for s in sets)
    assert whole in sets and counts[-1] >= near > 2000


def test_closed_blocks(spark):
    """A block stays closed when its union holds too little of the set, and opens otherwise."""
    schema = "group binary, block int, sid binary"
    sets = {b"q": range(100), b"m": range(0, 60), b"n": range(50, 99), b"x": range(1, 101)}
    full = spark.createDataFrame(
        [(s, np.array(list(t), np.uint64).tobytes()) for s, t in sets.items()], "sid binary, tokens binary"
    )
    pairs = spark.createDataFrame([(b"g", 0, b"q"), (b"h", 0, b"q")], schema)
    blocks = spark.createDataFrame([(b"g", 0, b"m"), (b"g", 0, b"n"), (b"h", 0, b"x")], schema)
    got = [(bytes(a), bytes(b)) for a, b in groupjoin._opened(pairs, blocks, full, 90).collect()]
    assert got == [(b"q", b"x")]


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = groupjoin.components_of(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand([(r.doc_id, r.text) for r in docs.collect()])


def counted_pairs(spark, monkeypatch, rows):
    """Pairs of a set and a block that the matrix brings together, the result being checked too."""
    counts, pairs = [], groupjoin._pairs

    def counting(*args):
        found = pairs(*args)
        counts.append(found.count())
        return found

    monkeypatch.setattr(groupjoin, "_pairs", counting)
    check(spark, rows)
    return sum(counts)


def test_a_shared_passage_makes_no_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    passage = " ".join(f"rare{i}" for i in range(40))
    rows = [(i, " ".join(f"c{rnd.randrange(50)}" for _ in range(200)) + " " + passage) for i in range(60)]
    assert counted_pairs(spark, monkeypatch, rows) < 60


def test_linked_sets_share_a_bundle():
    rnd, sets = np.random.default_rng(10), groupjoin.Sets(3)
    for n in [*range(1, 60), 145, 399, 1000, 5000]:
        for percent in (90, 60):
            own = np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
            least = groupjoin.needed(n, percent)
            other = np.sort(rnd.permutation(own)[:least])  # a part of the set, as small as links allow
            assert np.intersect1d(sets.bundles(own, percent), sets.bundles(other, percent)).size
            gone = n * (100 - percent) // (100 + percent) // 2 * 2
            swapped = rnd.integers(0, 1 << 64, gone // 2, dtype=np.uint64)
            other = np.unique(np.concatenate((rnd.permutation(own)[gone // 2 :], swapped)))
            assert np.intersect1d(sets.bundles(own, percent), sets.bundles(other, percent)).size
