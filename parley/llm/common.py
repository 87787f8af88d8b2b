"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 * 1024 * 1024  # text that one yielded Arrow batch holds at most, but one row


class Known(dict):
    """Answers that are kept, of two generations of at most ``size`` each.

    A full generation becomes the old one, and that one goes; what is asked for again moves on.
    Answers to keys that ``keeps`` turns down are worked out each time.
    """

    def __init__(self, size: int, compute: Callable, keeps: Callable[[Hashable], bool] | None = None):
        super().__init__()
        self.size, self.compute, self.keeps, self.old = size, compute, keeps, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if self.keeps is not None and not self.keeps(key):
                return value
        self.learnt(key, value)
        return value

    def learnt(self, key, value) -> None:
        """Keep an answer that was found elsewhere."""
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


def worker_kept(name: str, make: Callable):
    """What the Python worker keeps from task to task under a name, made at its first use.

    Task functions travel with this package by value, so that its own globals end with a task.
    """
    shelf = vars(sys.modules.setdefault("_parley_kept", types.ModuleType("_parley_kept")))
    if name not in shelf:
        shelf[name] = make()
    return shelf[name]


def give_back() -> None:
    """Return free memory to the system, since workers wait for their next task with all they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``mapInArrow``, whose workers keep no free memory between tasks."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_rows(
    df: DataFrame, schema: str, make: Callable[[], Callable[[dict], Iterator[tuple]]]
) -> DataFrame:
    """Run a row function over Arrow batches.

    ``make`` builds the row function once per task, inside the task. The row function takes
    the columns of a batch as Python lists and yields output tuples in schema order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in split(batch):
                rows = list(work({n: part.column(n).to_pylist() for n in part.schema.names}))
                if rows:
                    columns = list(zip(*rows))
                    arrays = [pa.array(c, f.type) for c, f in zip(columns, target)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return map_batches(df, run, schema)


def solve_groups(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    schema: str,
    solve: Callable[[list[dict]], Iterator[tuple]],
) -> DataFrame:
    """Deal rows by keys, and solve the rows of each key, which are of bounded number, at once."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*out), target)]
        return pa.RecordBatch.from_arrays(arrays, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, out = [], None, []
        for batch in batches:
            for part in split(batch):
                for row in part.to_pylist():
                    own = tuple(row[k] for k in keys)
                    if held and own != name:
                        out.extend(solve(held))
                        held = []
                        if len(out) > 10_000:
                            yield batch_of(out)
                            out = []
                    held.append(row)
                    name = own
        if held:
            out.extend(solve(held))
        if out:
            yield batch_of(out)

    return map_batches(rows.repartition(*keys).sortWithinPartitions(*keys, *order), run, schema)


def split(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes, never less than a row."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * limit / max(batch.get_total_buffer_size(), 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def text_bytes(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
