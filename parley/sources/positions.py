"""Rows beside each other by position, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.session import stage

ROW_BITS = 33  # of a row's place inside its partition, as Spark deals ids


def numbered(rows: DataFrame, *order: str, column: str = "position") -> DataFrame:
    """Rows numbered from 0 in the order of some columns.

    Rows are dealt by ranges of these columns and sorted inside; the numbers of rows of the partitions, one slim
    row each, give by prefix sums where every partition begins. One shuffle; ties have an order only as
    far as the columns give one. The numbered table is staged, so later reads see the same numbers.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(dealt.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", ROW_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id") - F.shiftleft("_part", ROW_BITS)
    # one row per partition
    numbers = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbers.withColumn(column, place).drop("_id", "_part", "_before")


def beside(left: DataFrame, right: DataFrame, column: str = "position") -> DataFrame:
    """Rows of equal position side by side; tables of different length are an error.

    A position that is missing on one side, or occurs twice, counts as a difference too.
    """
    def facts(rows: DataFrame):
        places = rows.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        return places.first()

    a, b = facts(left), facts(right)
    if a != b or (a["n"] and a["high"] - a["low"] + 1 != a["n"]):
        raise ValueError(f"rows do not stand beside each other: {a['n']} of {a['low']} to {a['high']}, "
                         f"{b['n']} of {b['low']} to {b['high']}")
    return left.join(right, column)
