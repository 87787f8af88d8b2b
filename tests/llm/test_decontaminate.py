"""Decontamination against a brute-force search of all windows."""

import hashlib
import random
import re

import pytest

from parley.llm import decontaminate


def word_list(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def by_hand(docs, items, span=10):
    windows = []
    for key, text in items:
        w = word_list(text)
        n = min(len(w), span)
        if key is not None and n:
            windows += [(str(key), w[i : i + n]) for i in range(len(w) - n + 1)]
    out = []
    for key, text in docs:
        w, hit, found = word_list(text), set(), set()
        for item, window in windows:
            for p in range(len(w) - len(window) + 1):
                if w[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    left = spark.createDataFrame(
        [(*r, 0, "n", [1]) for r in docs], "doc_id long, text string, name int, item string, met array<int>"
    )
    right = spark.createDataFrame(
        [(*r, 0, "n") for r in items], "item_id long, text string, doc_id int, parts string"
    )
    got = decontaminate.report(left, right, **options).collect()
    return sorted(map(tuple, got), key=str)


EDGE_DOCS = [
    (1, None),
    (2, ""),
    (3, "?!  ..."),
    (None, "one two three four five six seven eight nine ten eleven"),
    (4, "zero ONE two, three; four five six seven eight nine ten. end"),
    (4, "zero ONE two, three; four five six seven eight nine ten. end"),
    (5, "same " * 300),
    (6, "ÉCOLE école short item here"),
    (7, "x " * 5000 + "one two three four five six seven eight nine ten " * 3),
]
EDGE_ITEMS = [
    (10, "One two three four five six seven eight nine ten eleven twelve"),
    (9, "one two three four five six seven eight nine ten"),
    (9, "short ITEM"),
    (8, "same same same same same same same same same same same same"),
    (7, None),
    (6, " "),
    (None, "one two three four five six seven eight nine ten"),
    (11, "École"),
]


def test_edges(spark):
    assert run(spark, EDGE_DOCS, EDGE_ITEMS) == by_hand(EDGE_DOCS, EDGE_ITEMS)


@pytest.mark.parametrize("docs, items", [([], EDGE_ITEMS), (EDGE_DOCS, [])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items) == by_hand(docs, items)


@pytest.mark.parametrize("span, gram", [(10, 5), (6, 6), (8, 1)])
def test_against_all_windows(spark, span, gram):
    rnd = random.Random(span)
    pool = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choices(pool, k=rnd.randrange(1, 30)))) for i in range(20)]
    docs = []
    for i in range(60):
        parts = rnd.choices(pool, k=rnd.randrange(60))
        for _ in range(rnd.randrange(3)):
            source = word_list(rnd.choice(items)[1])
            a = rnd.randrange(len(source))
            at = rnd.randrange(len(parts) + 1)
            parts[at:at] = source[a : a + rnd.randrange(1, 15)]
        docs.append((i, " ".join(parts)))
    assert run(spark, docs, items, span=span, gram=gram) == by_hand(docs, items, span)


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame(EDGE_DOCS, "doc_id long, text string")
    items = spark.createDataFrame(EDGE_ITEMS, "item_id long, text string")
    plan = decontaminate.report(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
