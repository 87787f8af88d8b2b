"""Registered queries on counts, distributions, samples and data checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.catalog import sql
from parley.functions import text as tx
from parley.operators import evaluate, profile, quality, rules, sampling, tfidf, threads
from parley.session import shared_dir
from parley.sources import arrays, given, positions, ranges, sinks, tables
from parley.sources.given import table


def clean_dedup_messages(spark, folder):
    docs = tx.with_clean_text(table(spark, folder, "documents"), "text", "text_clean").select(
        "doc_id", "text_clean"
    )
    counted = docs.withColumn("word_count", tx.word_count(F.col("text_clean")))
    return threads.keep_first(counted.where("word_count >= 4"), "text_clean", "doc_id")


def clean_links(spark, folder):
    body = F.concat_ws(" ", "url", "html")
    return table(spark, folder, "pages").select("page_id", tx.clean_text(body).alias("text_clean"))


STOP_WORDS = ("the", "of", "and", "is", "de", "que", "le", "der")
REWRITE_HOSTS = ("spam-farm.example.org", "www.cheap-pills.example.com", "thther.example.org")
REWRITE_TARGET = "https://support.example.com"


def shortlink_rewrite(spark, folder):
    body = F.concat_ws(" ", "url", "html")
    return table(spark, folder, "pages").select(
        "page_id", tx.rewrite_shortlinks(body, REWRITE_HOSTS, REWRITE_TARGET).alias("text")
    )


def describe_lengths(spark, folder):
    return profile.describe(table(spark, folder, "documents"), "n_chars")


def turn_histogram(spark, folder):
    turns = table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return profile.histogram(turns, "turns")


def length_histogram(spark, folder):
    return profile.histogram(table(spark, folder, "documents"), "n_chars")


def share_by_value(spark, folder):
    return profile.shares(table(spark, folder, "documents"), "source")


def top_sources(spark, folder):
    return profile.top_values(table(spark, folder, "documents"), "source", 5)


def crosstab_margins(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return profile.crosstab(rows, "lang", "toxic", (0, 1))


def crosstab_with_nulls(spark, folder):
    """Documents without a label hold nulls, and one quality is not among the listed values."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return profile.crosstab(rows, "source", "quality", (1,))


def share_with_nulls(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return profile.shares(rows, "quality")


def describe_similarity(spark, folder):
    """Quantiles of doubles that are nearly all different."""
    first = table(spark, folder, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"))
    return profile.describe(first, "x")


def missing_key(spark, folder):
    """Checks on a sheet that lost its key and its notes."""
    sheet = _label_sheet(spark, folder).drop("conversation_id")
    return quality.annotation_violations(
        sheet, "conversation_id", {"intent_label": rules.INTENTS}, required=("notes",)
    )


def row_count(spark, folder):
    return quality.row_count_warning(table(spark, folder, "labels"), 200)


def both_verdicts(spark, folder):
    """One verdict over the violations of two sheets."""
    return quality.verdict(
        violations(spark, folder).unionByName(annotation_violations(spark, folder))
    )


def first_violations(spark, folder):
    return quality.first_violations(violations(spark, folder), 10)


def csv_round_trip(spark, folder):
    """Turns written as CSV with a byte order mark, and read again with their line breaks."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    path = f"{shared_dir(spark)}/csv_{uuid.uuid4().hex}"
    sinks.write_csv(turns, path, bom=True)
    return tables.read_csv(spark, path, turns.schema)


def csv_ranges(spark, folder):
    """The same file read by byte ranges, whose quote states a prefix sum gives."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    path = f"{shared_dir(spark)}/csv_{uuid.uuid4().hex}"
    sinks.write_csv(turns, path, bom=True)
    return ranges.read_csv(spark, path, turns.schema)


def array_positions(spark, folder):
    """Vectors written as array files in the order of their ids, and set beside the ids by position."""
    vectors = table(spark, folder, "embeddings")
    path = f"{shared_dir(spark)}/arrays_{uuid.uuid4().hex}"
    arrays.write_arrays(vectors, "vec_id", "embedding", path, file_rows=1000)
    ids = positions.numbered(vectors.select("vec_id"), "vec_id")
    rows = positions.beside(ids, arrays.read_arrays(spark, path))
    return rows.select("vec_id", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.round("value", 4)
    )


def failures_fallback(spark, folder):
    """Nothing is graded wrong, so the rows with the lowest grades stand in."""
    good = table(spark, folder, "labels").where("quality = 1").select(
        "doc_id", F.lit("fully_correct").alias("accuracy"), F.lit("correct_escalation").alias("escalation")
    )
    return evaluate.failures(good, "accuracy", "escalation", "doc_id")


def stop_words(spark, folder):
    found = tfidf.fit(table(spark, folder, "documents"), stop_words=STOP_WORDS)
    rows = [(term, round(idf, 6)) for term, idf in zip(found.terms, found.idf)]
    return spark.createDataFrame(rows, "term string, idf double")


def count_by_two(spark, folder):
    return profile.value_counts(given.messages(spark, folder), "cluster", "intent_label")


def label_summary(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return profile.label_summary(rows.withColumn("flag", F.col("toxic") == 1), "lang", "flag")


def exact_sample(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.exact_sample(docs, "doc_id", 100)


def stratified_sample(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "label")
    return sampling.stratified_sample(vectors, "label", "vec_id", 30)


def shuffled(spark, folder):
    return sampling.shuffled(table(spark, folder, "documents").select("doc_id", "source"), "doc_id")


def first_n_topup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.first_per_group(docs, "lang", "doc_id")


def _label_sheet(spark, folder):
    """Messages with flag columns read as text, as a labelling sheet holds them."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("conversation_id"),
        F.col("toxic").cast("string").alias("is_escalation"),
        F.col("quality").cast("string").alias("quality"),
    )
    return given.messages(spark, folder).join(labels, "conversation_id", "left")


def violations(spark, folder):
    return quality.label_violations(
        _label_sheet(spark, folder),
        "conversation_id",
        {"intent_label": rules.INTENTS},
        flags=("is_escalation",),
        texts=("first_customer_text_clean",),
    )


def violation_verdict(spark, folder):
    return quality.verdict(violations(spark, folder))


def annotation_violations(spark, folder):
    domains = {"quality": ("1",), "is_escalation": ("0",)}
    return quality.annotation_violations(_label_sheet(spark, folder), "conversation_id", domains)


def unfilled_fields(spark, folder):
    return quality.unfilled_fields(
        _label_sheet(spark, folder), "conversation_id", ("cluster", "is_escalation", "quality")
    )


def vector_coverage(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"))
    return quality.coverage(docs, vectors, "id")


QUERIES = {
    f.__name__: f
    for f in (
        clean_dedup_messages,
        clean_links,
        shortlink_rewrite,
        describe_lengths,
        turn_histogram,
        length_histogram,
        share_by_value,
        top_sources,
        crosstab_margins,
        csv_round_trip,
        csv_ranges,
        array_positions,
        failures_fallback,
        stop_words,
        crosstab_with_nulls,
        share_with_nulls,
        describe_similarity,
        missing_key,
        row_count,
        both_verdicts,
        first_violations,
        count_by_two,
        label_summary,
        exact_sample,
        stratified_sample,
        shuffled,
        first_n_topup,
        violations,
        violation_verdict,
        annotation_violations,
        unfilled_fields,
        vector_coverage,
    )
}


def _histogram(source: str, column: str) -> str:
    return f"""
WITH v AS ({source}),
span AS (SELECT min({column})::DOUBLE AS low, max({column})::DOUBLE AS high FROM v)
SELECT CASE WHEN high > low
            THEN least(floor(({column}::DOUBLE - low) / ((high - low) / 20)) + 1, 20)
            ELSE 1 END::INTEGER AS bin,
       count(*) AS n
FROM v, span GROUP BY bin"""


_SHEET = f"""
WITH {sql.MESSAGES},
sheet AS (
  SELECT m.*, l.toxic::VARCHAR AS is_escalation, l.quality::VARCHAR AS quality
  FROM messages m LEFT JOIN labels l ON l.doc_id = m.conversation_id)
"""
_ALLOWED = ", ".join(sorted(rules.INTENTS))
_BAD_INTENT = f"intent_label NOT IN ({sql.texts(rules.INTENTS)})"
_BAD_FLAG = "(is_escalation IS NULL OR is_escalation NOT IN ('0', '1'))"
_BLANK_TEXT = f"{sql.strip('text')} = ''"
_VIOLATIONS = f"""{_SHEET},
found AS (
  SELECT conversation_id::VARCHAR AS row_key, 'domain_intent_label' AS rule, intent_label AS value,
         'Invalid intent_label ''' || intent_label || '''. Must be one of: {_ALLOWED}' AS message
  FROM sheet WHERE {_BAD_INTENT}
  UNION ALL
  SELECT conversation_id::VARCHAR, 'flag_is_escalation', is_escalation,
         'Invalid is_escalation ''' || coalesce(is_escalation, 'null') || '''. Must be True or False.'
  FROM sheet WHERE {_BAD_FLAG}
  UNION ALL
  SELECT conversation_id::VARCHAR, 'blank_first_customer_text_clean', text,
         'Empty first_customer_text_clean.'
  FROM sheet WHERE {_BLANK_TEXT})
"""

_ANNOTATIONS = """SELECT conversation_id::VARCHAR AS row_key, 'unfilled' AS rule,
       concat_ws(', ', CASE WHEN quality IS NULL THEN 'quality' END,
                       CASE WHEN is_escalation IS NULL THEN 'is_escalation' END) AS value,
       'Missing ' || concat_ws(', ', CASE WHEN quality IS NULL THEN 'quality' END,
                       CASE WHEN is_escalation IS NULL THEN 'is_escalation' END) AS message
FROM sheet WHERE quality IS NULL OR is_escalation IS NULL
UNION ALL
SELECT conversation_id::VARCHAR, 'domain_quality', quality,
       'Invalid quality ''' || quality || '''. Must be one of: 1'
FROM sheet WHERE quality IS NOT NULL AND is_escalation IS NOT NULL AND quality <> '1'
UNION ALL
SELECT conversation_id::VARCHAR, 'domain_is_escalation', is_escalation,
       'Invalid is_escalation ''' || is_escalation || '''. Must be one of: 0'
FROM sheet WHERE quality IS NOT NULL AND is_escalation IS NOT NULL AND is_escalation <> '0'"""

ORACLE = {
    "clean_dedup_messages": f"""
WITH c AS (SELECT doc_id, {sql.clean('text')} AS text_clean FROM documents),
n AS (SELECT *, {sql.words('text_clean')} AS word_count FROM c)
SELECT doc_id, text_clean, word_count FROM n WHERE word_count >= 4
QUALIFY row_number() OVER (PARTITION BY text_clean ORDER BY doc_id) = 1""",
    "clean_links": f"SELECT page_id, {sql.clean('c')} AS text_clean "
    "FROM (SELECT page_id, concat_ws(' ', url, html) AS c FROM pages)",
    "shortlink_rewrite": f"""
SELECT page_id, regexp_replace(concat_ws(' ', url, html),
  'https?://(?:{"|".join(h.replace(".", "[.]") for h in REWRITE_HOSTS)})/{sql.NON_SPACE}+',
  '{REWRITE_TARGET}', 'g') AS text FROM pages""",
    "describe_lengths": """
SELECT count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std,
       min(n_chars)::DOUBLE AS min, round(quantile_cont(n_chars, 0.25), 6) AS p25,
       round(quantile_cont(n_chars, 0.5), 6) AS p50,
       round(quantile_cont(n_chars, 0.75), 6) AS p75, max(n_chars)::DOUBLE AS max
FROM documents""",
    "turn_histogram": _histogram(
        "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id", "turns"
    ),
    "length_histogram": _histogram("SELECT n_chars FROM documents", "n_chars"),
    "share_by_value": """
SELECT source, count(*) AS n,
       round(count(*) * 100.0 / (SELECT count(*) FROM documents), 1)::DOUBLE AS share_pct
FROM documents GROUP BY source""",
    "top_sources": "SELECT source, count(*) AS n FROM documents GROUP BY source "
    "ORDER BY n DESC, source LIMIT 5",
    "crosstab_margins": """
SELECT CASE WHEN grouping(lang) = 1 THEN 'All' ELSE lang END AS lang, grouping(lang) = 1 AS is_margin,
       count(*) FILTER (WHERE toxic = 0) AS "0", count(*) FILTER (WHERE toxic = 1) AS "1",
       count(*) AS "All"
FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""",
    "count_by_two": f"WITH {sql.MESSAGES} SELECT cluster, intent_label, count(*) AS n "
    "FROM messages WHERE cluster IS NOT NULL AND intent_label IS NOT NULL GROUP BY ALL",
    "csv_round_trip": "SELECT conv_id, turn, role, text FROM conversations",
    "csv_ranges": "SELECT conv_id, turn, role, text FROM conversations",
    "array_positions": "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, "
    "round(unnest(embedding)::DOUBLE, 4) AS value FROM embeddings",
    "failures_fallback": "SELECT doc_id, 'fully_correct' AS accuracy, 'correct_escalation' AS escalation "
    "FROM labels WHERE quality = 1 ORDER BY doc_id LIMIT 5",
    "stop_words": f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
kept AS (
  SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM words
  WHERE term NOT IN ({sql.texts(STOP_WORDS)}) GROUP BY term ORDER BY tf DESC, term LIMIT 2000)
SELECT term, round(ln((1 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1, 6) AS idf FROM kept""",
    "crosstab_with_nulls": """
SELECT CASE WHEN grouping(source) = 1 THEN 'All' ELSE source END AS source,
       grouping(source) = 1 AS is_margin, count(*) AS "1", count(*) AS "All"
FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND source IS NOT NULL
GROUP BY ROLLUP (source)""",
    "share_with_nulls": """
SELECT quality, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1)::DOUBLE AS share_pct
FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY quality""",
    "describe_similarity": """
WITH v AS (SELECT embedding[1]::DOUBLE AS x FROM embeddings)
SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
       round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50,
       round(quantile_cont(x, 0.75), 6) AS p75, max(x) AS max FROM v""",
    "missing_key": """
SELECT NULL::VARCHAR AS row_key, 'required_column' AS rule, c AS value,
       concat('Missing required column: ', chr(39), c, chr(39)) AS message
FROM (VALUES ('conversation_id'), ('notes')) t(c)""",
    "row_count": """
SELECT NULL::VARCHAR AS row_key, 'row_count' AS rule, count(*)::VARCHAR AS value,
       'Row count is ' || count(*) || ', expected 200.' AS message
FROM labels HAVING count(*) <> 200""",
    "label_summary": """
SELECT count(DISTINCT lang) AS labels, count(*) AS total, sum(toxic)::BIGINT AS flagged,
       round(avg(toxic) * 100, 1) AS flagged_pct
FROM documents JOIN labels USING (doc_id)""",
    "exact_sample": "SELECT doc_id, lang FROM documents "
    "ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id LIMIT 100",
    "stratified_sample": """
SELECT vec_id, label,
       row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR || ':42'), vec_id)::INTEGER AS pick
FROM embeddings QUALIFY pick <= 30""",
    "shuffled": "SELECT doc_id, source, md5(doc_id::VARCHAR || ':42') AS shuffle_key FROM documents",
    "first_n_topup": """
WITH r AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn,
         min(doc_id) OVER (PARTITION BY lang) AS seen FROM documents),
o AS (SELECT doc_id, lang,
        row_number() OVER (ORDER BY rn > 4, CASE WHEN rn > 4 THEN doc_id ELSE seen END, doc_id) AS pick
      FROM r)
SELECT doc_id, lang, pick::INTEGER AS pick FROM o WHERE pick <= 30""",
    "violations": f"{_VIOLATIONS} SELECT * FROM found",
    "violation_verdict": f"{_VIOLATIONS} SELECT count(*) AS violations, count(*) = 0 AS passed FROM found",
    "annotation_violations": f"{_SHEET} {_ANNOTATIONS}",
    "both_verdicts": f"""{_VIOLATIONS}, annotated AS ({_ANNOTATIONS}),
every AS (SELECT rule FROM found UNION ALL SELECT rule FROM annotated)
SELECT count(*) AS violations, count(*) = 0 AS passed FROM every""",
    "first_violations": f"{_VIOLATIONS} SELECT * FROM found ORDER BY rule, row_key LIMIT 10",
    "unfilled_fields": f"""{_SHEET},
b AS (
  SELECT conversation_id AS row_key,
         [x for x in [CASE WHEN cluster IS NULL THEN 'cluster' END,
                      CASE WHEN is_escalation IS NULL THEN 'is_escalation' END,
                      CASE WHEN quality IS NULL THEN 'quality' END] if x IS NOT NULL] AS f
  FROM sheet)
SELECT row_key, len(f)::INTEGER AS n_unfilled, array_to_string(f, ', ') AS fields FROM b WHERE len(f) > 0""",
    "vector_coverage": """
SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND e.vec_id IS NOT NULL) AS matched,
       count(*) FILTER (WHERE e.vec_id IS NULL) AS rows_without_vector,
       count(*) FILTER (WHERE d.doc_id IS NULL) AS vectors_without_row
FROM documents d FULL JOIN embeddings e ON e.vec_id = d.doc_id""",
}
