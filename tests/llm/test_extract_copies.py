"""Copies of a page under one or neighbouring paths do not erase each other."""

import random

import pytest

from parley.llm import extract

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, parts="8"):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = extract.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted((r.page_id, r.url, r.text) for r in got)


def page(*lines):
    return "".join(f"<div>{line}</div>" for line in lines)


def test_variants_keep_their_article(spark):
    rows = [(i, f"http://h/a?q={i}", f"<nav>menu {i}</nav>" + page("site", "article")) for i in range(3)]
    rows += [(2, "http://h/a?q=2", rows[2][2]), (5, "http://h/b", page("site", "other"))]
    rows += [(6, "http://only/x", page("same")), (7, "http://only/y", page("same"))]
    got = texts(spark, rows)
    assert [t for *_, t in got] == ["article"] * 4 + ["other", "same", "same"]


def expected(rows):
    """Neighbours in sorted order; those with the same open lines form a run."""
    order = sorted(range(len(rows)), key=lambda i: (*extract.place(rows[i][1]), rows[i][0]))
    lines = [extract.lines_of(r[2]) for r in rows]
    open_of = [[t for t, dropped, _ in own if not dropped] for own in lines]
    run, shared = {}, {}
    for i, j in zip([None, *order], order):
        near = i is not None and extract.place(rows[i][1])[0] == extract.place(rows[j][1])[0]
        copy = near and open_of[i] and open_of[i] == open_of[j]
        run[j] = run[i] if copy else j
        if near and not copy:
            for a, b in extract.common(*([t for t, *_ in lines[k]] for k in (i, j))):
                for k, place in ((i, a), (j, b)):
                    if not lines[k][place][1]:
                        at = sum(not dropped for _, dropped, _ in lines[k][:place])
                        shared.setdefault(run[k], set()).add(at)
    return sorted(
        (*rows[i][:2], " ".join(t for k, t in enumerate(open_of[i]) if k not in shared.get(run[i], ()))) for i in order
    )


@pytest.mark.parametrize("parts", ["1", "9", "40"])
def test_runs_across_ranges(spark, parts):
    rnd = random.Random(5)
    rows = []
    while len(rows) < 300:
        lines = [f"own {rnd.randrange(10**6)}" for _ in range(rnd.randrange(3))]
        lines += rnd.sample([f"site {i}" for i in range(4)], rnd.randrange(4))
        for _ in range(rnd.choice([1, 1, 2, 5, 60])):
            i = len(rows)
            nav = f"<nav>menu {rnd.randrange(3)}</nav>"
            rows.append((i, f"http://{rnd.choice('aaab')}.example/{i:04}?q={i}", nav + page(*lines)))
    want = expected(rows)
    rnd.shuffle(rows)
    assert texts(spark, rows, parts) == want
