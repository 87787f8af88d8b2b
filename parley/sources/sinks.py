"""Writers: CSV for spreadsheets, Parquet, text reports, keyed answer tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.functions.text import decimals

BOM = "\ufeff"


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV folder with a header in each part; the mark makes spreadsheets read UTF-8."""
    if bom:
        first = df.columns[0]
        df = df.withColumnRenamed(first, BOM + first)
    df.write.mode("overwrite").option("header", True).option("quote", '"').option(
        "escape", '"'
    ).csv(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Text report of ``(position, line)``; a report is a few dozen lines, so one file."""
    lines.orderBy("position").select("line").coalesce(1).write.mode("overwrite").text(path)


def append_keyed(df: DataFrame, path: str) -> None:
    """Add answers to a keyed table; earlier files are never rewritten."""
    df.write.mode("append").parquet(path)


def read_keyed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The keyed table, or an empty one when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def metric_lines(metrics: DataFrame) -> DataFrame:
    """``(system, metric, value)`` rows as aligned report lines."""
    text = F.format_string(
        "%-28s %-28s %s",
        F.col("system"),
        F.col("metric"),
        F.coalesce(decimals(F.col("value")), F.lit("n/a")),
    )
    return metrics.select(
        F.concat_ws("|", "system", "metric").alias("position"), text.alias("line")
    )
