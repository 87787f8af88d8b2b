"""Connected components of an edge table, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of edges ``a, b``; the root is the least node reached.

    Each round hangs the neighbours of every node under its least neighbour, first those
    above the node, then those below it; the number of rounds grows with the logarithm of the
    longest chain. Neighbours are never gathered, only their minimum is, so a node of any
    degree is no burden; its rows may be split by the join, which merges at any size.
    """
    links = stage(_down(edges.where("a <> b")))
    seen = None
    while True:
        links = stage(_small_star(_large_star(links)))
        state = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).first()
        if state == seen:
            break
        seen = state
    roots = links.select(F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("root").alias("node"), "root")
    )


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the greater to the lesser node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    above = both.where("b > a").join(least.hint("merge"), "a")
    return above.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    onward = links.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(onward).distinct()
