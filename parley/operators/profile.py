"""Counts, shares, distributions and cross tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.session import stage


def value_counts(df: DataFrame, *columns: str, nulls: bool = False) -> DataFrame:
    """Rows per value; rows with a null in any of the columns count only if asked for."""
    kept = df if nulls else df.dropna(subset=list(columns))
    return kept.groupBy(*columns).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(k)


def mode(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value; the smallest one wins a tie."""
    return top_values(df, column, 1).select(column)


def shares(df: DataFrame, column: str, digits: int = 1, nulls: bool = False) -> DataFrame:
    """Counts and their percentage of all rows counted; nulls as in :func:`value_counts`."""
    counts = value_counts(df, column, nulls=nulls)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share_pct", F.round(F.col("n") * 100.0 / total, digits))


def kept_share(kept: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows kept, rows in all and the percentage kept."""
    total = whole.agg(F.count("*")).scalar()
    return kept.agg(F.count("*").alias("kept")).select(
        "kept",
        total.alias("total"),
        F.round(F.col("kept") * 100.0 / total, 1).alias("kept_pct"),
    )


def order_statistics(df: DataFrame, column: str, quantiles: Sequence[float]) -> DataFrame:
    """Exact quantiles (linear interpolation) as one row ``q0, q1, ...``.

    Equal values are counted first, so a value held by a third of the rows is one row. The
    distinct values are dealt by ranges and lie in the shared folder with the number of their
    range; counts per range tell which ranges hold the wanted ranks, and only these are sorted,
    each in a task of its own. Without values every quantile is null.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    counts = values.groupBy("v").agg(F.count("*").alias("n"))
    ranged = stage(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    # one row per range from here on, until the ranges that matter are read again
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(W.orderBy("part")) - F.col("size")
    sizes = sizes.withColumn("before", before)
    ranges = sizes.agg(
        F.sum("size").alias("total"), F.collect_list(F.struct("part", "before", "size")).alias("ranges")
    )
    spots = F.array(*[F.lit(float(q)) * (F.col("total") - 1) for q in quantiles])
    ranks = ranges.select("ranges", F.posexplode(spots).alias("i", "spot")).select(
        "ranges", "i", "spot",
        F.explode(F.array_distinct(F.array(F.floor("spot"), F.ceil("spot")))).alias("rank"),
    )

    def holds(r: Column) -> Column:
        return (r["before"] <= F.col("rank")) & (F.col("rank") < r["before"] + r["size"])

    held = ranks.select("i", "spot", "rank", F.explode(F.filter("ranges", holds)).alias("r")).select(
        "i", "spot", "rank", "r.part", "r.before"
    )
    wanted = held.select("part", "before").distinct()
    upto = F.col("before") + F.sum("n").over(W.partitionBy("part").orderBy("v"))
    near = ranged.join(F.broadcast(wanted), "part").withColumn("upto", upto)
    found = held.select("i", "spot", "rank", "part").join(near.select("part", "v", "n", "upto"), "part")
    found = found.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    one = found.groupBy("i").agg((low + (high - low) * F.max(F.col("spot") - F.floor("spot"))).alias("q"))
    return one.agg(
        *[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(quantiles))]
    )


def describe(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum in one row."""
    value = F.col(column).cast("double")
    quartiles = order_statistics(df, column, (0.25, 0.5, 0.75))
    basics = df.agg(
        F.count(value).alias("n"),
        F.round(F.avg(value), digits).alias("mean"),
        F.round(F.stddev_samp(value), digits).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    row = quartiles.select(F.struct("q0", "q1", "q2")).scalar()
    return (
        basics.withColumn("q", row)
        .select(
            "n",
            "mean",
            "std",
            "min",
            F.round("q.q0", digits).alias("p25"),
            F.round("q.q1", digits).alias("p50"),
            F.round("q.q2", digits).alias("p75"),
            "max",
        )
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed."""
    value = F.col(column).cast("double")
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    span = counts.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high"))).scalar()
    width = (F.col("span.high") - F.col("span.low")) / bins
    spot = F.when(width > 0, F.floor((F.col("v") - F.col("span.low")) / width) + 1).otherwise(1)
    return (
        counts.withColumn("span", span)
        .select("n", F.least(spot, F.lit(bins)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts by two columns with margins; ``All`` names the margin row and column.

    ``values`` lists the column values, which fixes the result's columns; rows with another
    value, or a null in either column, are not counted anywhere. Cells are counted before
    the rollup. ``is_margin`` tells the margin row from a row value that reads ``All``.
    """
    kept = df.where(F.col(rows).isNotNull() & F.col(columns).isin(*values))
    cells = kept.groupBy(F.col(rows).alias("r"), F.col(columns).alias("c")).agg(F.count("*").alias("n"))
    cells_of = [
        F.coalesce(F.sum(F.when(F.col("c") == F.lit(v), F.col("n"))), F.lit(0)).alias(str(v))
        for v in values
    ]
    found = cells.rollup("r").agg(
        F.grouping("r").alias("g"), *cells_of, F.coalesce(F.sum("n"), F.lit(0)).alias("All")
    )
    is_margin = F.col("g") == 1
    name = F.when(is_margin, F.lit("All")).otherwise(F.col("r").cast("string"))
    return found.select(
        name.alias(rows), is_margin.alias("is_margin"), *[F.col(f"`{v}`") for v in values], "All"
    )


def thread_report(threads: DataFrame) -> DataFrame:
    """Row count, duplicate ids, missing texts, resolution rate, turn distribution."""
    ids = threads.groupBy("conversation_id").agg(F.count("*").alias("copies"))
    extra = ids.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).scalar()
    turns = describe(threads, "num_turns").select(F.struct("*")).scalar()
    report = threads.agg(
        F.count("*").alias("conversations"),
        F.count_if(F.col("first_customer_text").isNull()).alias("null_first_text"),
        F.count_if(F.col("last_brand_reply").isNull()).alias("null_last_reply"),
        F.round(F.avg(F.col("is_resolved").cast("double")) * 100, 1).alias("resolved_pct"),
    )
    return report.withColumn("duplicate_ids", extra).withColumn("t", turns).select(
        "conversations",
        "duplicate_ids",
        "null_first_text",
        "null_last_reply",
        "resolved_pct",
        F.col("t.mean").alias("turns_mean"),
        F.col("t.std").alias("turns_std"),
        F.col("t.min").alias("turns_min"),
        F.col("t.p25").alias("turns_p25"),
        F.col("t.p50").alias("turns_p50"),
        F.col("t.p75").alias("turns_p75"),
        F.col("t.max").alias("turns_max"),
    )


def label_summary(df: DataFrame, label: str, flag: str) -> DataFrame:
    """Distinct labels, flagged rows and their percentage.

    Labels are counted first; a distinct count over raw rows would expand them.
    """
    per_label = df.groupBy(label).agg(
        F.count("*").alias("n"), F.count_if(F.col(flag)).alias("flagged")
    )
    return per_label.agg(
        F.count(label).alias("labels"),
        F.sum("n").alias("total"),
        F.sum("flagged").alias("flagged"),
        F.round(F.sum("flagged") * 100.0 / F.sum("n"), 1).alias("flagged_pct"),
    )


def changed(old: Column, new: Column) -> Column:
    return ~new.eqNullSafe(old)
