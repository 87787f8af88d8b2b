"""Column functions over ``ARRAY<FLOAT|DOUBLE>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(vec: Column) -> Column:
    return F.sqrt(
        F.aggregate(as_doubles(vec), F.lit(0.0), lambda total, x: total + x * x)
    )


def unit(vec: Column) -> Column:
    """Scale to length one; a zero vector stays zero."""
    return F.transform(
        F.array_repeat(norm(vec), 1),
        lambda length: F.transform(
            as_doubles(vec), lambda x: F.when(length > 0, x / length).otherwise(x)
        ),
    ).getItem(0)
