"""Main text: markup rules, alignment against brute force, neighbours across ranges."""

import html
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from parley.llm import extract


def text_of(markup, shared=()):
    return " ".join(extract.chosen(extract.lines_of(markup), set(shared)))


@pytest.mark.parametrize(
    "markup, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<p>a<b>b</b>c</p><p>d", "abc d"),
        ("<nav>menu</nav><p>body</p><footer>foot</footer>", "body"),
        ("<script>if (a < b) '</p>'</script><style>p{}</style><p>x&nbsp;&#233;&copy</p>", "x é©"),
        ("<article><header><h1>T</h1></header><p>one<p>two</article><p>outside", "T one two"),
        ("<header>site</header><div class='Cookie-Notice'>c</div><div id=main>m</div>", "m"),
        ("<article>a<div class='comments'><p>first!</p></div><section>z</section></article>", "a z"),
        ("<form><article>in a form</article><input><button>go</button></form>", "in a form"),
        ("<body class='sidebar'><div role='navigation'>n</div><main>m<aside>s</aside></main>", "m"),
        ("<p hidden>h</p><p style='display: none'>d</p><p aria-hidden=true>a</p><p>k", "k"),
        ("<!-- c --><![CDATA[x]]><p>ok</p></div></p>", "ok"),
        ("<ul><li class='ad'>x<li>y</ul>", "y"),
    ],
)
def test_markup(markup, want):
    assert text_of(markup) == want


def brute(left, right):
    for n in range(min(len(left), len(right)), 0, -1):
        tails = {tuple(right[j] for j in c) for c in combinations(range(len(right)), n)}
        if any(tuple(left[i] for i in c) in tails for c in combinations(range(len(left)), n)):
            return n
    return 0


def test_alignment_is_longest():
    rnd = random.Random(1)
    for _ in range(300):
        left, right = (rnd.choices(range(4), k=rnd.randrange(8)) for _ in range(2))
        pairs = extract.common(left, right)
        assert len(pairs) == brute(left, right)
        assert all(left[i] == right[j] for i, j in pairs)
        assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


SCHEMA = "page_id long, url string, html string, host string, key int, shared string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, "s") for r in rows], SCHEMA)


def expected(rows):
    """Neighbours in the sorted order of each host, lines aligned by hand."""
    order = sorted(
        range(len(rows)), key=lambda i: (*extract.place(rows[i][1]), rows[i][0] or -1, rows[i][2] or "")
    )
    shared = {i: set() for i in order}
    for i, j in zip(order, order[1:]):
        if extract.place(rows[i][1])[0] and extract.place(rows[i][1])[0] == extract.place(rows[j][1])[0]:
            lines = [[t for t, _, _ in extract.lines_of(rows[k][2])] for k in (i, j)]
            for a, b in extract.common(*lines):
                shared[i].add(a)
                shared[j].add(b)
    return sorted((rows[i][0], rows[i][1], text_of(rows[i][2], shared[i])) for i in order)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_neighbours(spark, parts):
    rnd = random.Random(3)
    frame_lines = [f"<div>site line {i}</div>" for i in range(5)]
    rows = []
    for i in range(120):
        host = rnd.choice(["a.example", "a.example", "a.example", "b.example", f"h{i}.example"])
        own = [f"<div>own {rnd.randrange(10**6)}</div>" for _ in range(rnd.randrange(4))]
        lines = own + rnd.sample(frame_lines, rnd.randrange(5))
        rnd.shuffle(lines)
        rows.append((i, f"http://{host}/{rnd.choice('xyz')}/{i}?q={i}", "".join(lines)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = extract.main_text(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.page_id, r.url, r.text) for r in got) == expected(rows)
    assert all(r.n_chars == len(r.text) for r in got)


def test_edges(spark):
    page = "<div>same</div>"
    rows = [
        (1, None, page), (2, None, page), (3, "http://h/", None), (4, "::bad[", page), (None, "http://n/", page),
        (5, "http://h/a", page), (5, "http://h/a", page), (6, "http://h/b", "<main>same</main>" + page),
        (7, "http://long/", "<p>" + "word " * 200_000),
    ]
    got = extract.main_text(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert (by[1], by[2], by[3], by[4], by[None]) == ("same", "same", "", "same", "same")
    assert by[5] == "" and by[6] == "same" and len(by[7]) == 999_999
    assert extract.main_text(frame(spark, rows).limit(0)).collect() == []


def test_given_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = extract.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect()
    for r in got:
        inner = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
    assert pages.where(F.col("html").isNull()).count() == 0
