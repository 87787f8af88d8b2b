"""Registered queries on conversation threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.catalog import sql
from parley.functions import text as tx
from parley.operators import profile, threads
from parley.plans import corpus
from parley.session import stage
from parley.sources import given

HANDLE = "the"


def _pool(spark: SparkSession, folder: str, rows=threads.brand_pool) -> DataFrame:
    tweets = given.tweets(spark, folder)
    return rows(tweets, threads.brand_author(tweets, HANDLE).select("author_id").scalar())


def brand_mode(spark, folder):
    return threads.brand_author(given.tweets(spark, folder), HANDLE)


def outbound_authors(spark, folder):
    counts = threads.brand_counts(given.tweets(spark, folder), HANDLE)
    return counts.orderBy(F.desc("n"), "author_id").limit(5)


def pool_share(spark, folder):
    """Share of the pool before its duplicates go."""
    return profile.kept_share(_pool(spark, folder, threads.brand_rows), given.tweets(spark, folder))


def thread_roots(spark, folder):
    return threads.roots(stage(_pool(spark, folder))).select("tweet_id")


def thread_walk(spark, folder):
    return threads.walk(stage(_pool(spark, folder)))


def thread_fold(spark, folder):
    return corpus.brand_threads(given.tweets(spark, folder), HANDLE)


def thread_corpus(spark, folder):
    return corpus.corpus(given.tweets(spark, folder), HANDLE)


def reply_edges(spark, folder):
    """Every reply a tweet lists, with its place in the list."""
    listed = F.posexplode(tx.split_ids(F.col("response_tweet_id"))).alias("place", "reply_id")
    return given.tweets(spark, folder).select("tweet_id", listed)


def thread_qa_report(spark, folder):
    found = stage(thread_fold(spark, folder))
    return profile.thread_report(found)


QUERIES = {
    "brand_mode": brand_mode,
    "outbound_authors": outbound_authors,
    "pool_share": pool_share,
    "thread_roots": thread_roots,
    "thread_walk": thread_walk,
    "thread_fold": thread_fold,
    "thread_corpus": thread_corpus,
    "thread_qa_report": thread_qa_report,
    "reply_edges": reply_edges,
}

_CLEAN = f"""
SELECT conversation_id, num_turns, first_customer_text, last_brand_reply, conversation_text,
       is_resolved, created_at,
       {sql.clean('first_customer_text')} AS first_customer_text_clean,
       {sql.clean('last_brand_reply')} AS last_brand_reply_clean
FROM folded
"""

ORACLE = {
    "brand_mode": f"{sql.TWEETS} SELECT author_id, n FROM mentions ORDER BY n DESC, author_id LIMIT 1",
    "outbound_authors": f"{sql.TWEETS} SELECT author_id, n FROM mentions ORDER BY n DESC, author_id LIMIT 5",
    "pool_share": f"""{sql.POOL},
taken AS (
  SELECT (SELECT count(*) FROM replies) + (SELECT count(*) FROM tw WHERE tweet_id IN
    (SELECT parent FROM replies WHERE parent IS NOT NULL)) AS kept)
SELECT kept, (SELECT count(*) FROM tw) AS total,
       round(kept * 100.0 / (SELECT count(*) FROM tw), 1)::DOUBLE AS kept_pct FROM taken""",
    "thread_roots": f"{sql.POOL} SELECT tweet_id FROM roots",
    "thread_walk": f"{sql.WALK} SELECT root_id, turn_index, tweet_id FROM walk",
    "thread_fold": f"{sql.FOLD} SELECT * FROM folded",
    "thread_corpus": f"""{sql.FOLD}
, cleaned AS ({_CLEAN}),
counted AS (SELECT *, {sql.words('first_customer_text_clean')} AS customer_word_count FROM cleaned),
ranked AS (SELECT *, row_number() OVER (PARTITION BY first_customer_text_clean
                                        ORDER BY conversation_id) AS rn
           FROM counted WHERE customer_word_count >= 4)
SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1""",
    "reply_edges": """
SELECT concat_ws('-', conv_id, turn) AS tweet_id, (step - 1)::INTEGER AS place,
       concat_ws('-', conv_id, turn + step) AS reply_id
FROM conversations, (VALUES (1), (2)) s(step)""",
    "thread_qa_report": f"""{sql.FOLD}
SELECT count(*) AS conversations,
       count(*) - count(DISTINCT conversation_id) AS duplicate_ids,
       count(*) FILTER (WHERE first_customer_text IS NULL) AS null_first_text,
       count(*) FILTER (WHERE last_brand_reply IS NULL) AS null_last_reply,
       round(avg(CASE WHEN is_resolved THEN 1.0 ELSE 0.0 END) * 100, 1) AS resolved_pct,
       round(avg(num_turns), 6) AS turns_mean,
       round(stddev_samp(num_turns), 6) AS turns_std,
       min(num_turns)::DOUBLE AS turns_min,
       round(quantile_cont(num_turns, 0.25), 6) AS turns_p25,
       round(quantile_cont(num_turns, 0.5), 6) AS turns_p50,
       round(quantile_cont(num_turns, 0.75), 6) AS turns_p75,
       max(num_turns)::DOUBLE AS turns_max
FROM folded""",
}
