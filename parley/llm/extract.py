"""Main text of web pages, by their markup and by differences from the nearest page.

A page is parsed into text lines, one per block. Lines inside menus, headers, footers, side
bars, notices, adverts, forms, comments and the like are dropped by the element, its role or
the words of its class and id. Pages of a host are sorted by URL path; each is paired with the
page before and the page after it, the lines of both are aligned by longest common subsequence,
and shared lines are deleted. Neighbours whose remaining lines are all the same, such as the
variants of a path by their query, are copies: a run of copies counts as one page, is paired
with the pages before and after the run, and all its pages lose the same lines. A page whose
host has nothing but copies of it keeps all its lines. Copies that differ in a line are no copies.

Lines inside an ``article`` or ``main`` element are what the page is about and are not deleted,
even if another page has them too; a page that has such lines consists of them alone, so the
markup decides there and the differences nothing.

Only hashes of lines travel for the alignment. Pages are dealt by ranges of host and path, so
a host of any size is spread; pairs and runs across the seam of two ranges meet in a pass over
the first and last page of every range.

Rows: every input row gives one output row, repeated rows and null ids included. Null or empty
markup gives an empty text. Pages without a URL have no host and no neighbour. Equal
(host, path) are ordered by id, then by digest. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import map_rows, split
from parley.session import stage

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form frame iframe input map math menu "
    "menuitem nav noframes noscript object option script select style svg template textarea "
    "title video".split()
)
MAIN = frozenset(("article", "main"))
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search toolbar".split()
)
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead "
    "menu modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination paywall popup promo promoted promotion recommended related replies reply respond "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar "
    "tracking widget widgets".split()
)
WHOLE = frozenset(("html", "body", *MAIN))  # not dropped by their class or id
BLANKS, NOT_LETTERS = re.compile(r"\s+"), re.compile(r"[^a-z]+")


class Lines(HTMLParser):
    """Text blocks of a page: ``lines`` of (text, whether dropped, whether in the main part)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, bool, bool]] = []
        self.open: list[tuple[str, bool, bool]] = []  # element, dropped, main
        self.words: list[str] = []

    def state(self) -> tuple[bool, bool]:
        return self.open[-1][1:] if self.open else (False, False)

    def updatepos(self, i, j):
        """Line numbers are not asked for."""
        return j

    def end_line(self) -> None:
        if not self.words:
            return
        text = BLANKS.sub(" ", "".join(self.words)).strip()
        if text:
            self.lines.append((text, *self.state()))
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.end_line()
        elif tag in VOID:
            return
        if tag in VOID:
            return
        if self.open and self.open[-1][0] in ("p", "li") and tag not in INLINE:
            if self.open[-1][0] == "p" or tag == "li":
                self.open.pop()  # it ends where the next block begins
        dropped, main = self.state()
        if tag in MAIN and dropped and all(name == "form" for name in self.droppers()):
            dropped = False  # the form wraps the page
        own = tag in DROPPED or (tag == "header" and not main)
        own = own or bool(attrs) and not dropped and self.unwanted(tag, dict(attrs))
        if own and tag in INLINE:
            self.end_line()
        self.open.append((tag, dropped or own, main or tag in MAIN))

    def droppers(self) -> list[str]:
        """Open elements that began to drop."""
        before, out = False, []
        for name, dropped, _ in self.open:
            if dropped and not before:
                out.append(name)
            before = dropped
        return out

    def unwanted(self, tag: str, attrs: dict) -> bool:
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True
        if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return True
        if tag in WHOLE:
            return False
        if (attrs.get("role") or "").lower() in ROLES:
            return True
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        return not NAMES.isdisjoint(NOT_LETTERS.split(names))

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.end_line()

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if tag not in INLINE or (at is not None and self.open[at][1] != (at > 0 and self.open[at - 1][1])):
            self.end_line()
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        self.words.append(data)

    def unknown_decl(self, data):
        """Marked sections carry no text."""


def lines_of(markup: str | None) -> list[tuple[str, bool, bool]]:
    """Blocks in page order; a page of text without markup is one block."""
    parser = Lines()
    parser.feed(markup or "")
    parser.close()
    parser.end_line()
    return parser.lines


def chosen(lines: list[tuple[str, bool, bool]], shared: set[int]) -> list[str]:
    """The lines of the main text, given the places of lines that a neighbour has too."""
    main = [text for text, dropped, inside in lines if inside and not dropped]
    if main:
        return main
    return [t for i, (t, dropped, _) in enumerate(lines) if not dropped and i not in shared]


def place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "").lower(), parts.path.rstrip("/") or "/"
    except ValueError:
        return "", "/"


def common(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists."""
    n, m, start = len(left), len(right), 0
    while start < min(n, m) and left[start] == right[start]:
        start += 1
    end = 0
    while end < min(n, m) - start and left[n - 1 - end] == right[m - 1 - end]:
        end += 1
    places: dict[int, list[int]] = {}
    for j in range(m - end - 1, start - 1, -1):
        places.setdefault(right[j], []).append(j)
    # the least end of a common subsequence of each length, with the way there
    ends: list[int] = []
    ways: list[tuple] = []
    for i in range(start, n - end):
        for j in places.get(left[i], ()):
            k = bisect_left(ends, j)
            way = (i, j, ways[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                ways.append(way)
            elif j < ends[k]:
                ends[k], ways[k] = j, way
    middle, way = [], ways[-1] if ways else None
    while way:
        middle.append(way[:2])
        way = way[2]
    head = [(i, i) for i in range(start)]
    return head + middle[::-1] + [(n - end + k, m - end + k) for k in range(end)]


def _hashes(lines: list[tuple[str, bool, bool]]) -> list[int]:
    return [
        int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        for t, _, _ in lines
    ]


PAGE = "host string, path string, key {kind}, digest string, lines array<bigint>, open array<int>"
MEMBER, SHARED, END = "member", "shared", "end"  # kinds of rows of the first pass
SPREAD = 16  # parts into which the pages of one run are dealt


def _copies(left: dict, right: dict) -> bool:
    """Whether two pages have the same open lines; pages without any are nobody's copy."""
    if not left["open"] or len(left["open"]) != len(right["open"]):
        return False
    return all(left["lines"][i] == right["lines"][j] for i, j in zip(left["open"], right["open"]))


def _met(left: dict, right: dict) -> Iterator[dict]:
    """Which open lines, by their order among the open ones, two neighbours share."""
    for own, places in zip((left, right), zip(*common(left["lines"], right["lines"]))):
        places = set(places)
        shared = [k for k, i in enumerate(own["open"]) if i in places]
        if shared:
            yield {"task": own["task"], "run": own["run"], "shared": shared}


def _runs(pages: DataFrame, schema: str) -> DataFrame:
    """Runs of copies in a sorted table, and the lines shared at their seams.

    Pages become members of runs, numbered within the task. The first and last page of every
    task come out whole, for :func:`_across`.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for part in split(batch):
                out = []
                for row in part.to_pylist():
                    near = bool(before and row["host"] and before["host"] == row["host"])
                    copy = near and _copies(before, row)
                    number += before is not None and not copy
                    row |= {"task": task, "run": number}
                    if before is None:
                        out.append(row | {"kind": END})
                    if row["host"] and row["open"]:
                        own = {c: row[c] for c in ("key", "digest", "task", "run")}
                        out.append(own | {"kind": MEMBER})
                    if near and not copy:
                        out.extend(found | {"kind": SHARED} for found in _met(before, row))
                    before = row
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
        if before:
            yield pa.RecordBatch.from_pylist([before | {"kind": END}], schema=target)

    return pages.mapInArrow(run, schema)


def _across(ends: DataFrame) -> DataFrame:
    """Runs that go on in the next task, and the lines shared at seams between tasks.

    ``task, run, to_task, to_run`` name the run in which another begins; rows with ``shared``
    belong to the run they name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "task int, run int, to_task int, to_run int, shared array<int>"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for part in split(batch):
                out = []
                for row in part.to_pylist():
                    own = row["task"], row["run"]
                    row["own"], whole = own, own
                    if before and before["own"] == own:
                        whole = before["task"], before["run"]
                    elif before and before["own"][0] != own[0] and row["host"] and before["host"] == row["host"]:
                        if _copies(before, row):
                            whole = before["task"], before["run"]
                        else:
                            out.extend(_met(before, row))
                    row["task"], row["run"] = whole
                    if whole != own:
                        out.append(dict(zip(("task", "run", "to_task", "to_run"), (*own, *whole))))
                    before = row
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=target)

    return ends.mapInArrow(run, schema)


def _parsed(source: DataFrame, kind: str) -> DataFrame:
    """Each page once: its lines' hashes, and the lines that make its text.

    ``open`` holds the places of lines that the markup leaves open, neither dropped nor in a
    main part; where there is a main part, none are, and ``parts`` are its lines.
    """

    def make():
        def work(rows):
            for key, url, markup, digest in zip(*(rows[c] for c in ("key", "url", "markup", "digest"))):
                lines = lines_of(markup)
                has_main = any(main and not dropped for _, dropped, main in lines)
                own = [] if has_main else [i for i, (_, dropped, _) in enumerate(lines) if not dropped]
                yield (*place(url), key, digest, _hashes(lines), own, url, chosen(lines, set()))

        return work

    return map_rows(source, f"{PAGE.format(kind=kind)}, url string, parts array<string>", make)


def shared_lines(pages: DataFrame) -> DataFrame:
    """``page, print, shared``: which of its open lines a page shares with a neighbour."""
    kind = pages.schema["key"].dataType.simpleString()
    order = ["host", "path", "key", "digest"]
    schema = f"{PAGE.format(kind=kind)}, task int, run int, shared array<int>, kind string"
    slim = pages.select(*order, "lines", "open")
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage(_runs(ranged, schema))
    ends = found.where(F.col("kind") == END).drop("shared", "kind").dropDuplicates([*order, "task", "run"])
    # two pages per task of the pass before, whatever the number of pages
    across = stage(_across(ends.coalesce(1).sortWithinPartitions(*order, "task", "run")))
    links = F.broadcast(across.where("shared is null").drop("shared"))

    def whole(rows: DataFrame, *columns: str) -> DataFrame:
        run = (F.coalesce(f"to_{c}", c).alias(c) for c in ("task", "run"))
        return rows.join(links, ["task", "run"], "left").select(*run, *columns)

    met = whole(found.where(F.col("kind") == SHARED), "shared").unionByName(
        across.where("shared is not null").select("task", "run", "shared")
    )
    by_run = met.groupBy("task", "run").agg(F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared"))
    # pages of one run meet it in several parts, so none gathers them all
    dealt = by_run.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    members = whole(found.where(F.col("kind") == MEMBER), "key", "digest")
    parted = members.withColumn("part", F.pmod(F.hash("key", "digest"), F.lit(SPREAD)))
    joined = parted.join(dealt, ["task", "run", "part"])
    return joined.select(F.col("key").alias("page"), F.col("digest").alias("print"), "shared").dropDuplicates(
        ["page", "print"]
    )


def main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id, url, text, n_chars`` of every page."""
    source = pages.select(
        pages[id_col].alias("key"), pages[url_col].alias("url"), pages[html_col].alias("markup")
    ).withColumn("digest", F.md5(F.concat_ws("\n", "url", "markup")))
    rows = stage(_parsed(source, source.schema["key"].dataType.simpleString()))
    shared = stage(shared_lines(rows))
    same = F.col("key").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("print"))
    joined = rows.select("key", "digest", "url", "parts").join(shared, same, "left")
    own = F.filter("parts", lambda _, i: ~F.array_contains("shared", i))
    left = F.when(F.col("shared").isNull(), F.col("parts")).otherwise(own)
    return joined.select(
        F.col("key").alias(id_col), "url", F.array_join(left, " ").alias("text")
    ).withColumn("n_chars", F.length("text").cast("bigint"))
