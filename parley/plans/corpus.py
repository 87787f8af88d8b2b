"""From raw tweets to the message corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parley.operators import threads
from parley.sources import sinks


def brand_threads(tweets: DataFrame, handle: str, max_turns: int = 10) -> DataFrame:
    """Threads of the author who most often mentions ``handle``.

    The author is a subquery of the plan, not a value fetched beforehand.
    """
    brand = threads.brand_author(tweets, handle).select("author_id").scalar()
    return threads.rebuild_threads(tweets, brand, max_turns)


def corpus(tweets: DataFrame, handle: str, min_words: int = 4) -> DataFrame:
    """Threads with clean, long enough and distinct opening messages."""
    return threads.usable_threads(brand_threads(tweets, handle), min_words)


def write_corpus(tweets: DataFrame, handle: str, folder: str) -> DataFrame:
    """Write threads and messages as Parquet and return the threads read back."""
    path = f"{folder}/threads"
    corpus(tweets, handle).write.mode("overwrite").parquet(path)
    usable = tweets.sparkSession.read.parquet(path)
    messages = threads.customer_messages(usable)
    messages.write.mode("overwrite").parquet(f"{folder}/customer_messages")
    sinks.write_csv(messages, f"{folder}/customer_messages_csv")
    return usable
