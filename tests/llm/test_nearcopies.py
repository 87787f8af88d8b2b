"""Near-duplicates against brute force over all pairs."""

import random
from itertools import combinations

import pytest

from parley.llm import nearcopies
from parley.llm.components import components

SCHEMA = "doc_id long, text string, key int, node string, root string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", "r") for r in rows], SCHEMA)


def shingle_set(text, words=2):
    parts = (text or "").encode().lower().split()
    if not parts:
        return frozenset()
    size = min(words, len(parts))
    return frozenset(tuple(parts[i : i + size]) for i in range(len(parts) - size + 1))


def by_hand(rows, words=2, percent=80):
    sets = [shingle_set(t, words) for _, t in rows]
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
        if None in (rows[i][0], rows[j][0]) or not a or not b:
            continue
        if same_id or 100 * len(a & b) >= percent * len(a | b):
            above[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, (key, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        component = None if key is None else min(members)
        out.append((key, len(sets[i]), component, key is not None and component == key))
    return sorted(out, key=str)


def check(spark, rows, **options):
    got = nearcopies.components_of(frame(spark, rows), **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(rows, **options)


def copies(rnd, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed, groups, size, edits):
    rnd = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(30, 90))]
        texts += copies(rnd, base, rnd.randrange(1, size), edits)
    texts += [" ".join(f"w{rnd.randrange(400)}" for _ in range(60)) for _ in range(40)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("words", [2, 5])
def test_against_all_pairs(spark, words):
    check(spark, corpus(words, 25, 9, 4), words=words)


def test_crowded_regions_and_groups(spark, monkeypatch):
    """Groups beyond one task: some links lie outside the stars and the largest component."""
    for name, value in {"CROWD": 12, "BLOCK": 8, "CENTRES": 2, "DEEPEST": 9}.items():
        monkeypatch.setattr(nearcopies, name, value)
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = copies(rnd, base, 60, 7)
    chain = list(base)
    for step in range(12):  # each is near the one before, the ends are far apart
        for k in range(3):
            chain[(step * 3 + k) % 60] = f"c{step}{k}"
        texts.append(" ".join(chain))
    rnd.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"v{i % 9000}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "Éa b"), (7, "éa b"),
        (None, text), (10, text), (11, text.upper()), (11, text.upper()), (12, text + " end"),
        (13, "a b c"), (13, long), (14, long + " x"), (15, "a b c"), (16, "word " * 500), (17, "word word"),
    ]
    check(spark, rows)
    assert nearcopies.components_of(frame(spark, rows).limit(0)).collect() == []


def test_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (5, text + " x"), (8, "other " + text[:50]), (None, text), (1, None), (9, "z"), (9, "z")]
    out = nearcopies.dedup(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "key", "node", "root"]
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, 8, 9, None]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(300, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 60)}}
