"""Incoming messages scored as they arrive. No state is kept between messages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from parley.functions import text as tx
from parley.operators import rules
from parley.operators.enrich import answers
from parley.operators.systems import keyword_decision


def read_messages(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*", files: int = 100
) -> DataFrame:
    """New Parquet files in a folder as a stream, a bounded number per batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files)
        .parquet(folder)
    )


def read_table(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of files."""
    # as a pattern, since a plain path that names a file is taken for a folder
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{{{name}}}")


def score(
    messages: DataFrame,
    key: str,
    text: str,
    keywords: Sequence[str] = rules.ESCALATION_KEYWORDS,
    rule_table: Sequence[rules.Rule] = rules.SUPPORT_RULES,
    intent: str | None = None,
) -> DataFrame:
    """Clean the text, decide by keywords and by rules; plain column expressions only.

    Works the same on a table and on a stream. Without an intent column the rules see an
    empty intent.
    """
    base = messages.select(
        F.col(key),
        tx.clean_text(F.col(text)).alias("message"),
        (F.col(intent) if intent else F.lit("")).alias("intent_label"),
    )
    by_keyword = base.withColumns(keyword_decision(F.col("message"), keywords)).select(
        key,
        "message",
        "intent_label",
        tx.word_count(F.col("message")).alias("word_count"),
        F.col("is_escalation").alias("keyword_escalation"),
        F.col("escalation_reason").alias("keyword_reason"),
    )
    ruled = rules.apply_rules(by_keyword, rule_table, rules.SUPPORT_DEFAULT, "message")
    return ruled.withColumnsRenamed(
        {"is_escalation": "rule_escalation", "label_notes": "rule_note"}
    )


def write_batches(
    scored: DataFrame,
    sink: str,
    checkpoint: str,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Write each micro-batch to its own folder, overwritten when the batch is retried.

    ``enrich`` sees a micro-batch as a table, so it may retrieve cases or call a model.
    Runs through what is there and ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = enrich(batch) if enrich else batch
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (
        scored.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def answer_batches(
    messages: DataFrame,
    sink: str,
    checkpoint: str,
    store: str,
    call: Callable[[dict], str],
    key: str,
    text: str,
    schema: StructType | None = None,
) -> StreamingQuery:
    """Answers of a user's model to incoming messages, batch by batch: ``key, raw, error``.

    A batch writes its answers to the keyed table ``store`` before it writes its rows and commits, so a
    batch that fails in between and runs again finds them there, and no message is sent twice. A message that
    comes again, in the same batch or a later one, has its first answer.
    """

    def answer(batch: DataFrame) -> DataFrame:
        requests = batch.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
        return answers(requests.where("key is not null"), store, call, schema=schema)

    return write_batches(messages, sink, checkpoint, answer)
