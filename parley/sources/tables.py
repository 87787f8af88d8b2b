"""Readers: CSV with a fixed schema, Parquet staging, keyed vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley import schemas


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Quoted, possibly multi-line CSV. Columns are matched to the header by position.

    Here one task reads a whole file; :func:`parley.sources.ranges.read_csv` reads a large one by
    many tasks.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.TWEETS)


def stage_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write once as Parquet so that later scans prune columns and push filters."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write a table bucketed by its key: later joins on the key do not shuffle it.

    Worth it for raw tweets, whose text otherwise moves once per join on the tweet id.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDINGS).parquet(path)


def attach_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Vectors matched to rows by key; :func:`parley.sources.positions.beside` matches by position."""
    return rows.join(vectors, key)


def blank_columns(df: DataFrame, *names: str) -> DataFrame:
    """Empty columns for an annotator to fill."""
    return df.withColumns({name: F.lit("") for name in names})
