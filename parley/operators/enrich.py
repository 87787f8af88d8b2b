"""Calls to a user's model: embeddings in batches, cached answers by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.grades import JUDGE_FAILED
from parley.operators.threads import keep_first
from parley.sources.sinks import append_keyed, read_keyed

RAW_ANSWERS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

BROADCAST_KEYS = 500_000  # keys of requests that are sent to the answers
BROADCAST_BYTES = 32 * 1024 * 1024


def embed(
    df: DataFrame, text: str, make_model: Callable, out: str = "embedding", batch_size: int = 128
) -> DataFrame:
    """Add vectors from the user's model; ``make_model`` runs once per Python worker."""
    encode = predict_batch_udf(
        make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return df.withColumn(out, encode(F.coalesce(F.col(text), F.lit(""))))


def embed_missing(
    df: DataFrame,
    key: str,
    text: str,
    path: str,
    make_model: Callable,
    batch_size: int = 128,
    model: str = "default",
) -> DataFrame:
    """Vectors from the keyed table at ``path``; only rows it lacks are embedded.

    A vector belongs to an id, a text and a model: another text or ``model`` name is embedded
    anew. Rows without an id get no vector.
    """
    names = ["key", "print", "model"]
    schema = T.StructType(
        [
            *(T.StructField(name, T.StringType()) for name in names),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
        ]
    )
    print_of = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    keyed = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), print_of.alias("print"), F.lit(model).alias("model"),
        F.col(text).alias("text"),
    )
    known = read_keyed(df.sparkSession, path, schema)
    missing = keyed.join(known.select(*names), names, "left_anti").dropDuplicates(names)
    append_keyed(embed(missing, "text", make_model, batch_size=batch_size).drop("text"), path)
    stored = read_keyed(df.sparkSession, path, schema).where(F.col("model") == model)
    asked = stored.join(keyed.select(*names).distinct(), names, "left_semi")
    vectors = asked.dropDuplicates(names).select(
        F.col("key").alias("_key"), F.col("print").alias("_print"), "embedding"
    )
    same = (F.col(key).cast("string") == F.col("_key")) & (print_of == F.col("_print"))
    return df.join(vectors, same, "left").drop("_key", "_print")


def _few(asked: DataFrame, key: str) -> DataFrame:
    """The keys, marked for a broadcast if both their number and their bytes are checked to be few."""
    size = asked.limit(BROADCAST_KEYS + 1).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)).alias("bytes")
    )
    found = size.first()
    if found["n"] <= BROADCAST_KEYS and found["bytes"] <= BROADCAST_BYTES:
        return F.broadcast(asked)
    return asked


def answered(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The different keys of the requests that the table of answers holds.

    For a small set of requests their keys go to the answers, which are read where they lie: the history
    is not shuffled. A large set meets it by a shuffle.
    """
    asked = requests.select(key).distinct()
    return known.select(key).join(_few(asked, key), key, "left_semi").distinct()


def cached(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return requests.join(answered(requests, known, key), key, "left_semi")


def uncached(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requests without an answer, one per key, so that no key is sent twice."""
    others = [c for c in requests.columns if c != key]
    return keep_first(requests.join(answered(requests, known, key), key, "left_anti"), key, *others)


def ask(requests: DataFrame, call: Callable[[dict], str]) -> DataFrame:
    """Send each request to the user's function; a failed call leaves its error."""

    def one(row: dict) -> tuple[str | None, str | None]:
        try:
            return call(row), None
        except Exception as problem:  # the user's function may fail in any way
            return None, f"{type(problem).__name__}: {problem}"

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [one(row) for row in batch.to_dict("records")]
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "raw": [a for a, _ in answers],
                    "error": [e for _, e in answers],
                },
                dtype="object",
            )

    return requests.mapInPandas(send, RAW_ANSWERS)


def answers(
    requests: DataFrame,
    path: str,
    call: Callable[[dict], str],
    retry_failures: bool = False,
    schema: T.StructType | None = None,
) -> DataFrame:
    """``(key, raw, error)`` for every request key, calling only for unknown keys.

    New answers are written by key before anything reads them, so a job that starts again
    sends only what is still missing. With a ``schema``, an answer that does not parse into
    it is an error like a failed call, and is asked for again when failures are retried.
    """
    spark = requests.sparkSession
    wanted = requests.select("key").distinct()
    known = read_keyed(spark, path, RAW_ANSWERS)
    if retry_failures:
        known = known.where(F.col("error").isNull())
    fresh = ask(uncached(requests, known, "key"), call)
    if schema is not None:
        unread = F.col("error").isNull() & parse_answer(F.col("raw"), schema).isNull()
        fresh = fresh.withColumn("error", F.when(unread, "unreadable answer").otherwise(F.col("error")))
    append_keyed(fresh, path)
    table = read_keyed(spark, path, RAW_ANSWERS).join(_few(wanted, "key"), "key", "left_semi")
    return keep_first(table, "key", F.col("error").isNotNull(), "raw")


def parse_answer(raw: Column, schema: T.StructType) -> Column:
    """JSON text to a struct; null when it is no JSON or any field is missing."""
    parsed = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    complete = F.lit(True)
    for field in schema.fieldNames():
        complete = complete & parsed[field].isNotNull()
    return F.when(F.coalesce(complete, F.lit(False)), parsed)


def with_parsed(
    df: DataFrame, raw: str, schema: T.StructType, failed: str = JUDGE_FAILED
) -> DataFrame:
    """Add the answer's fields; a failed answer holds ``failed`` in its text fields."""
    fields = {
        field.name: (
            F.coalesce(F.col("_answer")[field.name], F.lit(failed))
            if isinstance(field.dataType, T.StringType)
            else F.col("_answer")[field.name]
        )
        for field in schema.fields
    }
    return df.withColumn("_answer", parse_answer(F.col(raw), schema)).withColumns(fields).drop("_answer")


def failure_count(df: DataFrame, field: str, failed: str = JUDGE_FAILED) -> DataFrame:
    return df.agg(
        F.count("*").alias("answers"), F.count_if(F.col(field) == failed).alias("failed")
    )
