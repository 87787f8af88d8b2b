"""The given Parquet tables, viewed as this library's data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import rules

BRAND = "agent"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _turn_id(offset: int) -> Column:
    return F.concat_ws("-", "conv_id", F.col("turn") + offset)


def as_tweets(conversations: DataFrame) -> DataFrame:
    """Turns as tweets that point to the turn before and list the two turns after."""
    role = F.col("role")
    return conversations.select(
        _turn_id(0).alias("tweet_id"),
        F.when(role == "user", F.concat(F.lit("customer"), F.col("conv_id")))
        .when(role == "assistant", BRAND)
        .otherwise(role)
        .alias("author_id"),
        (role == "user").alias("inbound"),
        F.format_string("turn %d", "turn").alias("created_at"),
        "text",
        F.concat_ws(", ", _turn_id(1), _turn_id(2)).alias("response_tweet_id"),
        F.when(F.col("turn") > 0, _turn_id(-1)).alias("in_response_to_tweet_id"),
    )


def tweets(spark: SparkSession, folder: str) -> DataFrame:
    return as_tweets(table(spark, folder, "conversations"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as customer messages; their vector's label plays the cluster."""
    docs = table(spark, folder, "documents")
    clusters = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster")
    )
    return docs.join(clusters, "doc_id", "left").select(
        F.col("doc_id").alias("conversation_id"),
        F.col("text").alias("first_customer_text_clean"),
        "cluster",
        rules.code_label(F.col("cluster"), rules.CLUSTER_INTENTS).alias("intent_label"),
        "lang",
        "source",
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("conversation_id"), "embedding", "label"
    )
