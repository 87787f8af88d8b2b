"""Spelling variants against edits compared pair by pair."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parley.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, key string"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
UPPER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def by_hand(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    counts = {w: n for w, n in counts.items() if n >= 5}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


def grouped(spark, rows):
    frame = spark.createDataFrame([(*r, "w", 1, "k") for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in spelling.grouped(frame).select(*COLUMNS).collect())


def misspelt(rnd, n):
    letters = "abcdeéüß÷ÿ"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(5, 9))) for _ in range(12)]
    rows = []
    for key in range(n):
        out = []
        for _ in range(rnd.randrange(60)):
            word = rnd.choice(words)
            if rnd.random() < 0.3:
                at = rnd.randrange(len(word))
                word = word[:at] + rnd.choice(["", "a", "é", word[at] * 2]) + word[at + 1 :]
            out.append(rnd.choice([word, word.upper(), f"{word}-", f"1{word}"]))
        rows.append((key, " ".join(out)))
    return rows


@pytest.mark.parametrize("shard, together", [(1 << 14, 1 << 21), (3, 1 << 21), (3, 8)])
def test_all_pairs(spark, monkeypatch, shard, together):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "ROUND", together)  # several rounds of broadcasts
    rows = misspelt(random.Random(1), 300)
    want = by_hand(rows)
    assert any(r[1] for r in want) and grouped(spark, rows) == want


def test_chains_ties_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "nullid " * 7), (3, "short " * 9), (3, "short " * 9), (4, "longer " * 5 + "aaaaaa " * 6)]
    rows += [(5, "aaaaaaa " * 30 + "aaaaaaaa " * 150), (6, "bbbbbb " * 5 + "bbbbbd " * 40 + "bbbbbc " * 40), (7, "ZÜRICH zÜrich zürich Zürich " * 3)]
    rows += [(8, "colour colour-colour.colour_colour " * 6 + "color " * 9 + "colours " * 200 + "ÀÀÀÀÀÀ " * 5), (9, "verylong" * 20_000 + " ") ] * 2
    rows += [(i, "verylong" * 2_000) for i in range(10, 18)]
    want = by_hand(rows)
    assert grouped(spark, rows) == want
    assert any(r[1] is not None and r[1] != r[2] for r in want)  # a form of a form


def test_dropped_letters(spark):
    rows = [(i, "stratosphere atmosphere hydrosphere lithosphere") for i in range(600)]
    want = by_hand(rows)
    assert len(want) > 4 or sum(r[3] for r in want) < 2400
    assert grouped(spark, rows) == want


def test_empty_table(spark):
    assert grouped(spark, []) == [] and grouped(spark, [(1, "once only")]) == []


def test_edits_as_hashes():
    words = ["stream", "street", "ÿàbcde"]
    points = spelling.letters_of(words)
    without = spelling.deletions(points)
    for i, word in enumerate(words):
        cut = [word[:k] + word[k + 1 :] for k in range(6)]
        assert (spelling.hashes_of(spelling.letters_of(cut)) == without[i]).all()
    hashes, greater = spelling.replacements(points, spelling.hashes_of(points))
    for i, word in enumerate(words):
        for k in (0, 3, 5):
            new = [word[:k] + chr(c) + word[k + 1 :] for c in spelling.LETTERS]
            assert (spelling.hashes_of(spelling.letters_of(new)) == hashes[i, k]).all()
            assert [chr(c) > word[k] for c in spelling.LETTERS] == greater[i, k].tolist()


def test_filters_pass_all_members_and_few_others():
    rnd = np.random.default_rng(3)
    members, others = rnd.integers(0, 1 << 63, (2, 20_000), dtype=np.uint64)
    blocks = -(-20_000 * spelling.WORD_BITS // 128)
    rows = np.zeros((blocks, 2), np.uint64)
    mixed = spelling.mixed(members)
    at, bits = spelling.block_of(mixed, blocks), spelling.bits_of(mixed)
    for half in range(2):
        np.bitwise_or.at(rows[:, half], at, bits[:, half])
    whole = spelling.Filter(blocks, 0, rows)
    assert len(whole.passing(members)) == 20_000 and len(whole.passing(others)) < 100
    parts = [spelling.Filter(blocks, a, rows[a : a + 1000]) for a in range(0, blocks, 1000)]
    assert sorted(np.concatenate([p.passing(members) for p in parts]).tolist()) == list(range(20_000))
