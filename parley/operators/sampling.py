"""Seeded samples whose rows do not depend on how the data is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seeded_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement, by top-n on a hash: no full sort."""
    return df.orderBy(seeded_key(key, seed), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in seeded order (a range-partitioned sort)."""
    return df.withColumn("shuffle_key", seeded_key(key, seed)).orderBy("shuffle_key", key)


def stratified_sample(df: DataFrame, by: str, key: str, n: int = 30, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per group; map tasks keep ``n`` per group before the shuffle."""
    order = W.partitionBy(by).orderBy(seeded_key(key, seed), key)
    return df.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n)


def first_per_group(
    df: DataFrame, by: str, order: str, per_group: int = 4, total: int = 30
) -> DataFrame:
    """First rows of each group, groups by first appearance, topped up from the rest.

    ``pick`` numbers the rows from 1. No group can supply more than ``per_group + total``
    rows, so only that many leave a map task.
    """
    groups = W.partitionBy(by)
    candidates = df.withColumn(
        "_rank", F.row_number().over(groups.orderBy(order))
    ).where(F.col("_rank") <= per_group + total)
    seen = candidates.withColumn("_seen", F.min(order).over(groups))
    extra = F.col("_rank") > per_group
    chosen = (
        seen.withColumn("_extra", extra)
        .withColumn("_place", F.when(extra, F.col(order)).otherwise(F.col("_seen")))
        .orderBy("_extra", "_place", order)
        .limit(total)
    )
    # The window sees at most ``total`` rows.
    place = W.orderBy("_extra", "_place", order)
    return chosen.withColumn("pick", F.row_number().over(place)).drop(
        "_rank", "_seen", "_extra", "_place"
    )


def preview(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)
