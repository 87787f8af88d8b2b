"""Data checks that return violations as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as tx


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [name for name in required if name not in df.columns]


def _violation(test: Column, rule: str, value: Column, message: Column) -> Column:
    return F.when(
        test,
        F.struct(F.lit(rule).alias("rule"), value.cast("string").alias("value"), message.alias("message")),
    )


def _domain_message(what: str, value: Column, allowed: Sequence[str]) -> Column:
    return F.concat(
        F.lit(f"Invalid {what} '"),
        F.coalesce(value.cast("string"), F.lit("null")),
        F.lit(f"'. Must be one of: {', '.join(sorted(allowed))}"),
    )


def _explode(df: DataFrame, key: str, checks: Sequence[Column]) -> DataFrame:
    """All checks in one scan; a row yields one output row per failed check."""
    failed = F.array_compact(F.array(*checks))
    return df.select(F.col(key).cast("string").alias("row_key"), F.explode(failed).alias("v")).select(
        "row_key", "v.rule", "v.value", "v.message"
    )


def label_violations(
    df: DataFrame,
    key: str,
    domains: Mapping[str, Sequence[str]],
    flags: Sequence[str] = (),
    texts: Sequence[str] = (),
    required: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(row_key, rule, value, message)`` for bad enums, flags and blank texts.

    A missing column, the key and the ``required`` ones included, is one violation of its own
    and stops the row checks.
    """
    missing = missing_columns(df, [key, *domains, *flags, *texts, *required])
    if missing:
        return df.sparkSession.createDataFrame(
            [(None, "required_column", c, f"Missing required column: '{c}'") for c in missing],
            "row_key string, rule string, value string, message string",
        )
    checks = []
    for name, allowed in domains.items():
        value = F.col(name)
        bad = ~F.coalesce(value.cast("string").isin(*allowed), F.lit(False))
        checks.append(_violation(bad, f"domain_{name}", value, _domain_message(name, value, allowed)))
    for name in flags:
        value = F.col(name)
        message = F.concat(
            F.lit(f"Invalid {name} '"),
            F.coalesce(value.cast("string"), F.lit("null")),
            F.lit("'. Must be True or False."),
        )
        checks.append(_violation(tx.parse_flag(value).isNull(), f"flag_{name}", value, message))
    for name in texts:
        value = F.col(name)
        checks.append(_violation(tx.is_blank(value), f"blank_{name}", value, F.lit(f"Empty {name}.")))
    return _explode(df, key, checks)


def unfilled_fields(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows with blank annotation fields, and which ones."""
    blanks = F.array_compact(F.array(*[F.when(tx.is_blank(F.col(f)), F.lit(f)) for f in fields]))
    return (
        df.select(F.col(key).alias("row_key"), blanks.alias("_blank"))
        .where(F.size("_blank") > 0)
        .select(
            "row_key",
            F.size("_blank").alias("n_unfilled"),
            F.array_join("_blank", ", ").alias("fields"),
        )
    )


def annotation_violations(
    df: DataFrame, key: str, domains: Mapping[str, Sequence[str]], required: Sequence[str] = ()
) -> DataFrame:
    """Unfilled rows yield one violation and skip the domain checks."""
    fields = list(domains)
    if missing_columns(df, [key, *fields, *required]):
        return label_violations(df, key, domains, required=required)
    unfilled = F.lit(False)
    for name in fields:
        unfilled = unfilled | tx.is_blank(F.col(name))
    names = F.array_join(
        F.array_compact(F.array(*[F.when(tx.is_blank(F.col(f)), F.lit(f)) for f in fields])), ", "
    )
    checks = [_violation(unfilled, "unfilled", names, F.concat(F.lit("Missing "), names))]
    for name, allowed in domains.items():
        value = tx.strip(F.col(name))
        bad = ~unfilled & ~value.isin(*allowed)
        checks.append(_violation(bad, f"domain_{name}", value, _domain_message(name, value, allowed)))
    return _explode(df, key, checks)


def row_count_warning(df: DataFrame, expected: int) -> DataFrame:
    return (
        df.agg(F.count("*").alias("n"))
        .where(F.col("n") != expected)
        .select(
            F.lit(None).cast("string").alias("row_key"),
            F.lit("row_count").alias("rule"),
            F.col("n").cast("string").alias("value"),
            F.format_string(f"Row count is %d, expected {expected}.", "n").alias("message"),
        )
    )


def verdict(violations: DataFrame) -> DataFrame:
    """One row: how many violations, and whether the check passes."""
    return violations.agg(F.count("*").alias("violations")).withColumn(
        "passed", F.col("violations") == 0
    )


def first_violations(violations: DataFrame, n: int = 10) -> DataFrame:
    return violations.orderBy("rule", "row_key").limit(n)


def coverage(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Keys found in only one of the two tables, counted by side.

    Keys are counted on each side before they meet, so neither nulls nor repeated keys gather
    rows in one task; a null key matches nothing.
    """
    left = rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("a"))
    right = vectors.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("b"))
    a, b = (F.coalesce(F.col(c), F.lit(0)) for c in "ab")
    return left.join(right, "k", "full_outer").agg(
        F.coalesce(F.sum(a * b), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(b == 0, a)), F.lit(0)).alias("rows_without_vector"),
        F.coalesce(F.sum(F.when(a == 0, b)), F.lit(0)).alias("vectors_without_row"),
    )
