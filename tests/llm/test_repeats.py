"""Repeated passages against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from parley.llm import repeats

SCHEMA = "doc_id long, text string, key int, digest string, cut int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2) for r in rows], SCHEMA)


def by_hand(rows, span):
    raws = [(t or "").encode() for _, t in rows]
    times = Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for (key, _), r in zip(rows, raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if times[r[i : i + span]] > 1:
                gone[i : i + span] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((key, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, span, gram):
    got = repeats.report(frame(spark, rows), span=span, gram=gram).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows, span)


def corpus(seed, n, letters="ab cdé", passages=6):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choices(letters, k=k))
    shared = [text(rnd.randrange(20, 120)) for _ in range(passages)]
    rows = []
    for i in range(n):
        parts = [text(rnd.randrange(60)) for _ in range(rnd.randrange(4))]
        parts += rnd.choices(shared, k=rnd.randrange(3))
        rnd.shuffle(parts)
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("span, gram", [(24, 8), (17, 4), (9, 1)])
def test_against_all_windows(spark, span, gram):
    rows = corpus(span, 120)
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "a" * 300), (203, "ab" * 200)]
    check(spark, rows, span, gram)


def test_crowded_anchors_are_halved(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 5)
    rnd = random.Random(4)
    middle = "".join(rnd.choices("abcdefgh", k=40))
    rows = [
        (i, "".join(rnd.choices("xyz ", k=30)) + middle[: 20 + i % 21] + "".join(rnd.choices("uvw", k=30)))
        for i in range(90)
    ]
    check(spark, rows, 24, 8)


def test_edges(spark):
    long = "".join(random.Random(1).choices("abcdefghij é", k=30_000))
    rows = [
        (1, None), (2, None), (3, ""), (4, "x" * 399), (5, "x" * 399), (6, "y" * 400), (7, "y" * 400),
        (None, long), (8, long[5000:6000] + "tail"), (9, "same row " * 60), (9, "same row " * 60),
        (9, "another text under the same id " + long[100:450]), (10, "z" * 401),
    ]
    check(spark, rows, repeats.SPAN, repeats.GRAM)
    assert repeats.report(frame(spark, rows).limit(0)).collect() == []


def test_places_beyond_a_segment(monkeypatch):
    text = "".join(random.Random(6).choices("abcdefgh", k=5000)).encode()
    whole = repeats.Windows(text, 40, 8)
    monkeypatch.setattr(repeats, "SEGMENT", 128)
    parts = repeats.Windows(text, 40, 8)
    # anchors of equal windows stay equal, wherever segments are cut
    again = repeats.Windows(text[1234:3000], 40, 8)
    at = np.repeat(parts.at, parts.last - parts.first + 1)
    other = np.repeat(again.at, again.last - again.first + 1)
    assert (at[1234 : 1234 + len(other)] == other + 1234).all()
    assert whole.count == parts.count


def test_cut_texts(spark):
    passage = "é" * 30
    rows = [(1, "one " + passage + " end"), (2, passage + "two"), (3, "clean text"), (4, None)]
    out = repeats.cut(frame(spark, rows), span=40, gram=8)
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert {r.doc_id: r.text for r in out.collect()} == {1: "one  end", 2: "two", 3: "clean text", 4: None}


def test_columns_sorted_as_by_hand():
    rnd = random.Random(3)
    strings, offsets, groups = [], [], []
    for _ in range(200):
        s = bytes(rnd.choices(b"ab", k=rnd.randrange(12, 20)))
        strings.append(s)
        offsets.append(rnd.randrange(4))
        groups.append(rnd.randrange(9))
    allowed = [(0, len(s) - 6) for s in strings]
    got = repeats.shared_windows(np.array(groups), strings, offsets, allowed, 6)
    for i, (s, o, g) in enumerate(zip(strings, offsets, groups)):
        want = [
            a for a in range(len(s) - 5)
            if any(
                j != i and groups[j] == g and a - o + offsets[j] >= 0
                and strings[j][a - o + offsets[j] :][:6] == s[a : a + 6]
                for j in range(len(strings))
            )
        ]
        assert [a for x, y in got[i] for a in range(x, y + 1)] == want


def test_passing_copies_are_removed(spark, monkeypatch):
    from pathlib import Path

    from parley import session

    monkeypatch.setattr(repeats, "BLOCK", 5)
    folder = Path(session.shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("stage-*"))
    rows = corpus(12, 60)
    check(spark, rows, 24, 8)
    assert len(set(folder.glob("stage-*")) - before) == 2  # the slim rows and what is removed
