"""Quoted multi-line CSV read by many tasks, whatever the size of a file.

A byte range of a file cannot know whether it begins inside quotes. But each range maps the state at
its begin to that at its end by the parity of its quotes alone, and these maps compose: a prefix sum
of the parities, one row per range, gives every range its true state. Then all ranges cut their lines into
records at once. A record that a range's end tears is put together from its pieces, of which a
range has two at most. Records are parsed by Spark's own CSV expression.

Quotes inside a field are doubled, as spreadsheets and pandas write them. A line break inside quotes
stays as it is; one outside, with or without a carriage return before it, ends a record. Empty lines
are skipped. The first record of every file is its header. Files that are compressed as a
whole are one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.session import stage

WHOLE, HEAD, TAIL = 0, 1, 2  # a record, the end of one from before, the start of one that goes on
PIECES = "file string, start bigint, kind int, header boolean, text string"
BATCH = 4096


def _cut(lines: Iterator[tuple]) -> Iterator[tuple]:
    """Pieces of the records in lines ``value, file, start, inside``, in the order of the files."""
    name, held, quoted, header, headed = None, [], False, False, False

    def last() -> Iterator[tuple]:
        if held:
            # a range that ends inside quotes leaves its last record open
            kind = HEAD if headed and quoted else TAIL if quoted else HEAD if headed else WHOLE
            yield (*name, kind, header, "\n".join(held))

    for value, file, start, inside in lines:
        if (file, start) != name:
            yield from last()
            name, held, quoted, headed = (file, start), [], bool(inside), bool(inside)
            header = start == 0 and not quoted
        held.append(value)
        if value.count('"') % 2:
            quoted = not quoted
        if not quoted:
            yield (*name, HEAD if headed else WHOLE, header, "\n".join(held))
            held, header, headed = [], False, False
    yield from last()


def records(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of every record but the headers, as it stands in the files."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = stage(lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd")))
    before = F.sum("odd").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    states = ranges.select("file", "start", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        held = []
        for piece in _cut(rows):
            held.append(piece)
            if len(held) >= BATCH:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "start", "kind", "header", "text"])

    # one slim row per range; a broadcast keeps the lines in their order
    placed = lines.join(F.broadcast(states), ["file", "start"]).select("value", "file", "start", "inside")
    pieces = stage(placed.mapInArrow(run, PIECES))
    whole = pieces.where(F.col("kind") == WHOLE).select("header", "text")
    torn = pieces.where(F.col("kind") != WHOLE)
    order = W.partitionBy("file").orderBy("start", "kind")
    slim = torn.select("file", "start", "kind", F.sum((F.col("kind") == TAIL).cast("int")).over(order).alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("start", "header", "text")))
    joined = torn.join(slim, ["file", "start", "kind"]).groupBy("file", "record").agg(parts.alias("parts"))
    joined = joined.select(
        F.element_at("parts", 1)["header"].alias("header"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"),
    )
    every = whole.unionByName(joined).where(~F.col("header"))
    return every.select(F.regexp_replace("text", "\r$", "").alias("text")).where("text <> ''")


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of quoted, multi-line CSV files; columns are matched to the header by position."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    options = {"quote": '"', "escape": '"'}
    return records(spark, path).select(F.from_csv("text", ddl, options).alias("row")).select("row.*")
