"""Registered queries on TF-IDF, embeddings of texts, answer parsing and streaming."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.catalog import sql
from parley.catalog.labels import KEYWORDS
from parley.operators import enrich, postings, rules, tfidf
from parley.session import shared_dir
from parley.sources import given
from parley.sources.given import table
from parley.streaming import triage

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def tfidf_vocabulary(spark, folder):
    stats = tfidf.term_statistics(table(spark, folder, "documents"))
    return stats.orderBy(F.desc("tf"), "term").limit(2000)


def tfidf_weights(spark, folder):
    docs = table(spark, folder, "documents")
    rows = tfidf.weights(docs, "doc_id", "text", tfidf.fit(docs))
    return rows.select(F.col("id").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


def tfidf_nn(spark, folder):
    """Nearest document of every benchmark text."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "text")
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("key"), "text")
    return tfidf.nearest(docs, queries, "key", "text").select(
        F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "similarity"
    )


def tfidf_nn_blocks(spark, folder):
    """The same by the inverted index, whose blocks are ruled out by upper bounds."""
    docs = table(spark, folder, "documents")
    vocabulary = tfidf.fit(docs)
    rows = tfidf.vectorize(docs, "doc_id", "text", vocabulary)
    queries = tfidf.vectorize(table(spark, folder, "benchmark"), "item_id", "text", vocabulary)
    return postings.block_topk(rows, queries, 1).select(
        F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "similarity"
    )


def letter_shares():
    """Stand-in for a user's embedding model: the share of each letter a to z."""

    def predict(texts: np.ndarray) -> np.ndarray:
        counts = np.array([[t.lower().count(c) for c in LETTERS] for t in texts], dtype="float32")
        return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)

    return predict


def embed_batch(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = enrich.embed(docs, "text", letter_shares)
    return found.select("doc_id", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 4)
    )


ANSWER = T.StructType([T.StructField("k", T.LongType())])


def parse_json(spark, folder):
    """Answers with one in five broken: error events carry plain text instead of JSON."""
    raw = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("props"))
    rows = table(spark, folder, "events").select("event_id", raw.alias("raw"))
    parsed = enrich.parse_answer(F.col("raw"), ANSWER)
    return rows.select("event_id", parsed["k"].alias("k"), parsed.isNull().alias("failed"))


def cache_misses(spark, folder):
    """Documents with a label count as answered; the others would be sent."""
    requests = table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "source")
    known = table(spark, folder, "labels").select(F.col("doc_id").alias("key"))
    hits = enrich.cached(requests, known, "key").withColumn("state", F.lit("hit"))
    misses = enrich.uncached(requests, known, "key").withColumn("state", F.lit("miss"))
    return hits.unionByName(misses)


def answer_length(row: dict) -> str:
    """Stand-in for a user's model: it answers with the text's length and fails on licenses."""
    if "license" in row["text"]:
        raise ValueError("refused")
    return json.dumps({"k": len(row["text"])})


def cached_answers(spark, folder):
    """Labelled documents are asked first; the second run asks only the others."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("key"), "text")
    labels = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("key"))
    path = f"{shared_dir(spark)}/answers_{uuid.uuid4().hex}"
    enrich.answers(docs.join(labels, "key", "left_semi"), path, answer_length)
    asked = enrich.answers(docs, path, answer_length)
    parsed = enrich.parse_answer(F.col("raw"), ANSWER)
    return asked.select("key", parsed["k"].alias("k"), "error")


def stream_answers(spark, folder):
    """The documents as a stream, answered by the stand-in model; a second run of it asks nothing anew."""
    schema = table(spark, folder, "documents").schema
    place = f"{shared_dir(spark)}/stream_answers_{uuid.uuid4().hex}"
    for turn in ("first", "again"):
        stream = triage.read_table(spark, f"{folder}/documents.parquet", schema)
        triage.answer_batches(
            stream, f"{place}/{turn}", f"{place}/state_{turn}", f"{place}/answers", answer_length, "doc_id", "text"
        ).awaitTermination()
    stored = spark.read.parquet(f"{place}/answers").groupBy("key").agg(F.count("*").alias("times"))
    rows = spark.read.parquet(f"{place}/again").drop("batch").join(stored, "key")
    return rows.select("key", enrich.parse_answer(F.col("raw"), ANSWER)["k"].alias("k"), "error", "times")


def stream_triage(spark, folder):
    """Customer turns read as a file stream, scored, and written batch by batch."""
    schema = table(spark, folder, "conversations").schema
    stream = triage.read_table(spark, f"{folder}/conversations.parquet", schema)
    inbound = given.as_tweets(stream).where("inbound")
    scored = triage.score(inbound, "tweet_id", "text", KEYWORDS)
    place = f"{shared_dir(spark)}/stream_triage_{uuid.uuid4().hex}"
    triage.write_batches(scored, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").drop("batch")


QUERIES = {
    f.__name__: f
    for f in (
        tfidf_vocabulary,
        tfidf_weights,
        tfidf_nn,
        tfidf_nn_blocks,
        embed_batch,
        parse_json,
        cache_misses,
        cached_answers,
        stream_answers,
        stream_triage,
    )
}

_LETTER_ROWS = "SELECT unnest(range(26)) AS pos"
_HITS = sql.hits("low", KEYWORDS)

ORACLE = {
    "tfidf_vocabulary": f"WITH {sql.TERMS} SELECT term, total::BIGINT AS tf, df FROM vocabulary",
    "tfidf_weights": f"WITH {sql.TERMS} SELECT doc_id, term, round(weight, 6) AS weight FROM weights",
    "tfidf_nn": f"""WITH {sql.TERMS},
qwords AS (
  SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
  FROM benchmark),
qraw AS (
  SELECT item_id, term, count(*) * any_value(idf) AS w
  FROM qwords JOIN vocabulary USING (term) GROUP BY item_id, term),
qweights AS (
  SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM qraw),
dots AS (
  SELECT q.item_id, d.doc_id, sum(q.weight * d.weight) AS s
  FROM qweights q JOIN weights d USING (term) GROUP BY q.item_id, d.doc_id),
every AS (
  SELECT b.item_id, d.doc_id, round(coalesce(s, 0), 6) AS similarity
  FROM benchmark b JOIN documents d ON TRUE LEFT JOIN dots USING (item_id, doc_id))
SELECT item_id, doc_id, similarity FROM every
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) = 1""",
    "embed_batch": f"""
WITH low AS (SELECT doc_id, lower(text) AS t FROM documents),
counted AS (
  SELECT doc_id, pos, length(t) - length(replace(t, chr(97 + pos::INTEGER), '')) AS n
  FROM low, ({_LETTER_ROWS}))
SELECT doc_id, pos::INTEGER AS pos,
       round(n::FLOAT / greatest(sum(n) OVER (PARTITION BY doc_id), 1)::FLOAT, 4)::DOUBLE AS value
FROM counted""",
    "parse_json": """
SELECT event_id,
       CASE WHEN event_type <> 'error'
            THEN CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) END AS k,
       event_type = 'error' AS failed
FROM events""",
    "cache_misses": """
SELECT doc_id AS key, source,
       CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'hit' ELSE 'miss' END AS state
FROM documents""",
    "cached_answers": """
SELECT doc_id::VARCHAR AS key, CASE WHEN NOT contains(text, 'license') THEN length(text) END AS k,
       CASE WHEN contains(text, 'license') THEN 'ValueError: refused' END AS error
FROM documents""",
    "stream_triage": f"""{sql.TWEETS},
m AS (SELECT tweet_id, {sql.clean('text')} AS message FROM tw WHERE inbound),
f AS (SELECT *, lower(message) AS low FROM m),
h AS (SELECT *, {_HITS} AS found,
             {sql.matches('low', rules.SECURITY_PATTERNS)} AS security,
             {sql.matches('low', rules.LOCKOUT_PATTERNS)} AS lockout,
             {sql.matches('low', rules.BILLING_PATTERNS)} AS billing FROM f)
SELECT tweet_id, message, '' AS intent_label, {sql.words('message')} AS word_count,
       found <> '' AS keyword_escalation,
       CASE WHEN found <> '' THEN 'Keyword heuristic triggered by terms: ' || found
            ELSE 'No escalation keywords detected; auto-handled.' END AS keyword_reason,
       security OR lockout OR billing AS rule_escalation,
       CASE WHEN security THEN {sql.quote(rules.SUPPORT_RULES[0].note)}
            WHEN lockout THEN {sql.quote(rules.SUPPORT_RULES[1].note)}
            WHEN billing THEN {sql.quote(rules.SUPPORT_RULES[2].note)}
            ELSE {sql.quote(rules.SUPPORT_DEFAULT.note)} END AS rule_note
FROM h""",
}
ORACLE["tfidf_nn_blocks"] = ORACLE["tfidf_nn"]
ORACLE["stream_answers"] = f"SELECT *, 1::BIGINT AS times FROM ({ORACLE['cached_answers']})"
