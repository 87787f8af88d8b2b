"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's fingerprints are the least hashes of its k-word grams in every run of
``span - k + 1`` neighbouring grams. Any ``span`` words that a document and a benchmark item
share hold one such run in both, hence one fingerprint: no shared span of that length is
missed. Fingerprints of documents are joined with those of the items; where one meets, the
offset between both texts is kept, and along it the hit is extended and compared word by word.
An item shorter than the span is one window; all grams of its length are its fingerprints.

Rows: every document row gives one output row, repeated rows and repeated or null ids
included; a null text has no words. Benchmark rows without an id or without words match
nothing; rows that repeat an item id are windows of one item. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.session import stage

SPAN = 10  # words of a window
GRAM = 5  # words of a fingerprint's gram
#: Fixed value: the characters between words, after A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it in an expression, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, BETWEEN), "")


def steps(first: Column | int, last: Column) -> Column:
    """The numbers from first to last, none if last comes before first."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def grams(parts: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words."""
    return F.transform(
        steps(1, F.size(parts) - length + 1), lambda i: F.xxhash64(F.slice(parts, i, length))
    )


def least(hashes: Column, run: int) -> Column:
    """The distinct least hashes of all runs of neighbouring grams."""
    return F.array_distinct(
        F.transform(
            steps(1, F.size(hashes) - run + 1), lambda i: F.array_min(F.slice(hashes, i, run))
        )
    )


def fingerprints(parts: Column, span: int, gram: int, short: list[int]) -> Column:
    """Winnowed hashes of the grams, and all grams of each short item length."""
    own = [let(grams(parts, gram), lambda g: least(g, span - gram + 1))]
    own += [grams(parts, length) for length in short]
    return F.array_distinct(F.concat(*own)) if short else own[0]


def _items(benchmark: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """``item, name, parts, marks``: words and fingerprints of every item that has words."""
    item = benchmark[id_col].cast("string").alias("item")
    split = benchmark.where(benchmark[id_col].isNotNull()).select(
        item, words(benchmark[text_col]).alias("parts")
    )
    split = stage(split.where(F.size("parts") > 0).distinct())
    marks = F.when(
        F.size("parts") >= span, let(grams(F.col("parts"), gram), lambda g: least(g, span - gram + 1))
    ).otherwise(F.array(F.xxhash64("parts")))
    name = F.sha2(F.concat_ws(" ", "item", F.array_join("parts", " ")), 256)
    return stage(split.select("item", name.alias("name"), "parts", marks.alias("marks")))


def _starts(doc: Column, hashes: Column, item: Column, span: int, gram: int) -> Column:
    """Where windows of an item begin in a document: hits extended along their offsets."""
    parts, marks = item["parts"], item["found"]

    def places(values: Column, mark: Column) -> Column:
        return F.filter(steps(0, F.size(values) - 1), lambda i: values[i] == mark)

    def offsets(own: Column) -> Column:
        met = F.transform(
            marks,
            lambda m: let(
                places(own, m),
                lambda q: F.flatten(
                    F.transform(places(hashes, m), lambda p: F.transform(q, lambda x: p - x))
                ),
            ),
        )
        return F.array_distinct(F.flatten(met))

    def extended(offset: Column) -> Column:
        last = F.least(F.size(doc), F.size(parts) + offset) - span
        return F.filter(
            steps(F.greatest(F.lit(0), offset), last),
            lambda p: F.slice(doc, p + 1, span) == F.slice(parts, p - offset + 1, span),
        )

    long = let(
        grams(parts, gram),
        lambda own: F.array_distinct(F.flatten(F.transform(offsets(own), extended))),
    )
    whole = F.filter(
        steps(0, F.size(doc) - F.size(parts)),
        lambda p: F.slice(doc, p + 1, F.size(parts)) == parts,
    )
    return F.when(F.size(parts) >= span, long).otherwise(whole)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """``row, n_words, items, hit``: items with windows in a text, places of hit words.

    ``row`` holds all columns of the document.
    """
    items = _items(benchmark, item_col, item_text_col, span, gram)
    sizes = items.where(F.size("parts") < span).select(F.size("parts").alias("n")).distinct()
    short = sorted(r.n for r in sizes.collect())  # fewer than ``span`` lengths
    body = F.col("row")[text_col]
    source = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row")[id_col].alias("doc"), F.md5(F.coalesce(body, F.lit(""))).alias("digest")
    )
    prints = source.select(
        "doc",
        "digest",
        F.explode(let(words(body), lambda w: fingerprints(w, span, gram, short))).alias("mark"),
    )
    marks = stage(items.select(F.explode("marks").alias("mark"), "name"))
    hits = prints.join(marks, "mark").groupBy("doc", "digest", "name").agg(
        F.collect_set("mark").alias("found")
    )
    met = hits.join(items.select("name", "item", "parts"), "name").groupBy("doc", "digest").agg(
        F.collect_list(F.struct("item", "parts", "found")).alias("met")
    )
    met = stage(met)
    same = F.col("doc").eqNullSafe(F.col("met_doc")) & (F.col("digest") == F.col("met_digest"))
    # one plan for every size: texts are dealt by document, whatever the number of hits
    met = met.withColumnsRenamed({"doc": "met_doc", "digest": "met_digest"}).hint("merge")
    joined = source.join(met, same, "left")

    def windows(own: Column) -> Column:
        return let(
            grams(own, gram),
            lambda g: F.transform(
                F.col("met"),
                lambda m: F.struct(
                    m["item"].alias("item"),
                    F.least(F.size(m["parts"]), F.lit(span)).alias("length"),
                    _starts(own, g, m, span, gram).alias("starts"),
                ),
            ),
        )

    def result(own: Column) -> Column:
        found = F.when(
            F.col("met").isNotNull(), F.filter(windows(own), lambda x: F.size(x["starts"]) > 0)
        )
        covered = lambda f: F.array_distinct(
            F.flatten(
                F.transform(
                    f,
                    lambda x: F.flatten(
                        F.transform(
                            x["starts"], lambda s: F.sequence(s, s + x["length"] - 1)
                        )
                    ),
                )
            )
        )
        return let(
            found,
            lambda f: F.struct(
                F.size(own).alias("n_words"),
                F.coalesce(
                    F.array_sort(F.array_distinct(F.transform(f, lambda x: x["item"]))),
                    F.array().cast("array<string>"),
                ).alias("items"),
                F.coalesce(covered(f), F.array().cast("array<int>")).alias("hit"),
            ),
        )

    found = F.explode(F.array(let(words(body), result))).alias("result")
    return joined.select("row", found).select("row", "result.*")


def report(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """``id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    slim = docs.select(docs[id_col], docs[text_col])
    found = overlaps(slim, benchmark, id_col=id_col, text_col=text_col, **options)
    return found.select(
        F.col("row")[id_col].alias(id_col),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.size("hit").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any window of the benchmark, all columns."""
    return overlaps(docs, benchmark, **options).where(F.size("hit") == 0).select("row.*")


#: The same rows in SQL: all windows of both sides joined as text.
ORACLE = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_place AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS p
  FROM item WHERE len(w) > 0
), item_window AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p + 1 : p + n], ' ') AS t FROM item_place
), doc_place AS (
  SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p
  FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(w) >= n
), doc_window AS (
  SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS t FROM doc_place
), met AS (
  SELECT doc_id, item_id, n, p FROM doc_window JOIN item_window USING (n, t)
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM met) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM met) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
