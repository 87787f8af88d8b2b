"""Conversation threads from reply pointers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.session import stage


def brand_counts(tweets: DataFrame, handle: str) -> DataFrame:
    """Outbound tweets that mention the handle, counted by author."""
    mentions = F.coalesce(F.contains(F.lower("text"), F.lit(handle.lower())), F.lit(False))
    return (
        tweets.where(mentions & ~F.col("inbound"))
        .groupBy("author_id")
        .agg(F.count("*").alias("n"))
    )


def brand_author(tweets: DataFrame, handle: str) -> DataFrame:
    """One row: the author with most such tweets; the smallest id wins a tie."""
    return brand_counts(tweets, handle).orderBy(F.desc("n"), "author_id").limit(1)


def spread_null(key: Column, unique: Column) -> Column:
    """Give each null key a value of its own that no id equals.

    An outer or anti join would send all null keys to one task.
    """
    return F.coalesce(key, F.concat(F.lit("\u0000"), unique))


def keep_first(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """First row per key. Spark limits each map task's groups before the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_first", rank).where("_first = 1").drop("_first")


def brand_rows(tweets: DataFrame, brand: Column | str) -> DataFrame:
    """The brand's tweets and the tweets they answer; a tweet may be both.

    The parent ids are made distinct before their shuffle, so a tweet answered by very
    many replies is one key.
    """
    is_brand = F.col("author_id") == (F.lit(brand) if isinstance(brand, str) else brand)
    replies = tweets.where(is_brand)
    parents = (
        replies.select(F.col("in_response_to_tweet_id").alias("tweet_id"))
        .where(F.col("tweet_id").isNotNull())
        .distinct()
    )
    customers = tweets.join(parents, "tweet_id", "left_semi").select(*tweets.columns)
    return replies.withColumn("_source", F.lit(0)).unionByName(
        customers.withColumn("_source", F.lit(1))
    )


def brand_pool(tweets: DataFrame, brand: Column | str) -> DataFrame:
    """The brand's tweets and the tweets they answer, one row per id."""
    both = brand_rows(tweets, brand)
    return keep_first(both, "tweet_id", "_source", "created_at", "text").drop("_source")


def roots(pool: DataFrame) -> DataFrame:
    """Inbound tweets whose parent is absent or lies outside the pool."""
    ids = pool.select(F.col("tweet_id").alias("known"))
    parent = spread_null(F.col("in_response_to_tweet_id"), F.col("tweet_id"))
    return (
        pool.where("inbound")
        .withColumn("parent", parent)
        .join(ids, F.col("parent") == F.col("known"), "left_anti")
        .select("tweet_id", tx.first_id(F.col("response_tweet_id")).alias("next_id"))
    )


def _follow(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Add the next turn to each path, or end the thread."""
    found = F.col("k").isNotNull() & ~F.array_contains("path", F.col("k"))
    return (
        state.withColumn("probe", spread_null(F.col("next_id"), F.col("root_id")))
        .join(edges, F.col("probe") == F.col("k"), "left")
        .select(
            "root_id",
            F.when(found, F.array_append("path", F.col("k"))).otherwise(F.col("path")).alias("path"),
            F.when(found, F.col("k_next")).alias("next_id"),
        )
    )


def walk(
    pool: DataFrame, max_turns: int = 10, set_aside: Sequence[int] = (2, 4)
) -> DataFrame:
    """Follow each root's first reply: rows ``(root_id, turn_index, tweet_id)``.

    A thread stops at an id outside the pool, at an id it already holds, and at
    ``max_turns``. One slim row per root is widened by joins on the reply id; text joins
    only afterwards. Most threads are short, so after the joins listed in ``set_aside`` the
    ended ones are put by and only the others go on. Between those points an ended thread
    gets a key of its own, so they spread over all tasks.
    """
    edges = pool.select(
        F.col("tweet_id").alias("k"),
        tx.first_id(F.col("response_tweet_id")).alias("k_next"),
    )
    state = roots(pool).select(
        F.col("tweet_id").alias("root_id"), F.array("tweet_id").alias("path"), "next_id"
    )
    ended = []
    for joins in range(1, max_turns):
        state = _follow(state, edges)
        if joins in set_aside and joins < max_turns - 1:
            state = stage(state)
            ended.append(state.where("next_id is null"))
            state = state.where("next_id is not null")
    paths = reduce(DataFrame.unionByName, ended, state)
    return paths.select("root_id", F.posexplode("path").alias("turn_index", "tweet_id"))


def role_of(author: Column, brand: Column, brand_role: str = "BRAND") -> Column:
    return F.when(author.eqNullSafe(brand), brand_role).otherwise("CUSTOMER")


def fold(
    turns: DataFrame,
    pool: DataFrame,
    brand: Column | str,
    min_turns: int = 2,
    brand_role: str = "BRAND",
) -> DataFrame:
    """One row per thread. A group holds at most the walk's ``max_turns`` rows."""
    brand = F.lit(brand) if isinstance(brand, str) else brand
    is_brand = F.col("author_id").eqNullSafe(brand)
    text = tx.strip(F.coalesce("text", F.lit("")))
    lines = turns.join(
        pool.select("tweet_id", "author_id", "created_at", "text"), "tweet_id"
    ).select(
        "root_id",
        "turn_index",
        "created_at",
        is_brand.alias("by_brand"),
        text.alias("said"),
        role_of(F.col("author_id"), brand, brand_role).alias("role"),
    )
    turn = F.col("turn_index")
    by_brand = F.col("by_brand")
    said = F.col("said")
    ordered = F.array_sort(
        F.collect_list(F.struct("turn_index", F.concat_ws(": ", "role", "said").alias("line")))
    )
    return (
        lines.groupBy(F.col("root_id").alias("conversation_id"))
        .agg(
            F.count("*").cast("int").alias("num_turns"),
            F.min_by(said, F.when(~by_brand, turn)).alias("first_customer_text"),
            F.max_by(said, F.when(by_brand, turn)).alias("last_brand_reply"),
            F.array_join(F.transform(ordered, lambda x: x["line"]), " | ").alias(
                "conversation_text"
            ),
            F.max_by(by_brand, turn).alias("is_resolved"),
            F.min_by("created_at", turn).alias("created_at"),
        )
        .where(F.col("num_turns") >= min_turns)
    )


def rebuild_threads(
    tweets: DataFrame, brand: Column | str, max_turns: int = 10, min_turns: int = 2
) -> DataFrame:
    """Pool, walk and fold. The pool is read by roots, edges and texts, so it is staged."""
    pool = stage(brand_pool(tweets, brand))
    return fold(walk(pool, max_turns), pool, brand, min_turns)


def add_clean_columns(threads: DataFrame) -> DataFrame:
    return (
        tx.with_clean_text(threads, "first_customer_text", "first_customer_text_clean")
        .withColumn("last_brand_reply_clean", tx.clean_text(F.col("last_brand_reply")))
        .withColumn("customer_word_count", tx.word_count(F.col("first_customer_text_clean")))
    )


def usable_threads(threads: DataFrame, min_words: int = 4) -> DataFrame:
    """Long enough openings, one thread per distinct opening (the lowest id)."""
    long_enough = add_clean_columns(threads).where(F.col("customer_word_count") >= min_words)
    return keep_first(long_enough, "first_customer_text_clean", "conversation_id")


def customer_messages(usable: DataFrame) -> DataFrame:
    return usable.select(
        "conversation_id",
        "first_customer_text_clean",
        "num_turns",
        "is_resolved",
        "customer_word_count",
    )
