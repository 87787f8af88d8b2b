"""Exact top-k by cosine similarity, without a cross join.

Two ways, both exact:

* few queries: they are broadcast after their size is checked, dense ones as a matrix, sparse
  ones as postings; each task scores its own part of the corpus and keeps k rows per query;
* many queries: both sides are cut into blocks that meet on a block key. Dense vectors
  are first grouped into cells around pivots, and the triangle inequality on angles rules
  out the cells that cannot hold a better neighbour. Sparse rows are searched by
  :mod:`parley.operators.postings`.

Ties go to the lowest id. Similarities are rounded before they are ranked, so the order
does not depend on the order of summation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.operators.best import Best, margin_of
from parley.operators.postings import Postings, SparseRows, best_of, block_topk
from parley.operators.sampling import exact_sample
from parley.session import release, stage

DIGITS = 6
BROADCAST_BYTES = 64 * 1024 * 1024
SCORE_CELLS = 4_000_000  # scores held at once by one task
PROBE_ROWS = 16_384  # queries that a task places at once


def _whole(vec: F.Column) -> F.Column:
    """No null and no NaN among the values; NaN is the greatest value there is."""
    return (F.size(F.array_compact(vec)) == F.size(vec)) & ~F.isnan(F.coalesce(F.array_max(vec), F.lit(0.0)))


def usable(vec: F.Column) -> F.Column:
    """Whether there is a vector, without NaN or null in it; never null."""
    return vec.isNotNull() & F.coalesce(_whole(vec), F.lit(False))


def dense(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``(id, vec)`` rows; rows without a vector, or with a NaN or null in it, have no neighbours.

    :func:`unusable` lists them. Vectors of different lengths end the search with an error.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec").isNotNull() & _whole(F.col("vec")))


def unusable(df: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """``(id, reason)`` of rows whose vector is missing, holds NaN or null, or has another length."""
    rows = df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    reason = (
        F.when(F.col("vec").isNull(), "missing")
        .when(F.size("vec") != width, "length")
        .when(~_whole(F.col("vec")), "not a number")
    )
    return rows.select("id", reason.alias("reason")).where("reason is not null")


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(lengths > 0, lengths, 1.0)


def _list_lengths(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The ``vec`` rows of an Arrow batch as unit vectors."""
    column = batch.column("vec")
    lengths = _list_lengths(column)
    if batch.num_rows and (lengths != lengths[0]).any():
        other = batch.column("id").filter(pa.array(lengths != lengths[0]))[:5].to_pylist()
        raise ValueError(f"vectors of different lengths, for example those of {other}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return _unit_rows(flat.reshape(batch.num_rows, -1))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").to_numpy(zero_copy_only=False)


def _keep(found: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = found.sort_values(["similarity", "id"], ascending=[False, True], kind="stable")
    return ordered.groupby("query_id", sort=False).head(k)


def _hit_schema(query_id: T.DataType, row_id: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_id),
            T.StructField("id", row_id),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _merge(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _width_of(queries: DataFrame, width: int | None) -> int:
    if width is not None:
        return width
    first = queries.select(F.size("vec")).first()
    return first[0] if first else 1


def topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 3,
    width: int | None = None,
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(query_id, id, similarity, rank)`` of the k nearest corpus rows per query.

    Both inputs hold ``id`` and either ``vec`` or, with ``width`` given, sparse ``indices``
    and ``values``. Query ids are unique.
    """
    room = max(1, broadcast_bytes // (8 * _width_of(queries, width)))
    some = queries.limit(room + 1).toArrow()
    if some.num_rows <= room:
        return _merge(_scan(corpus, queries, some, k, width, exclude_self), k)
    return distinct_topk(corpus, queries, k, width, exclude_self)


def distinct_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 3,
    width: int | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """Exact top-k for query sets of any size; equal rows are searched once.

    Of equal corpus rows only the lowest ``k + 1`` ids can be among anybody's ``k``; equal
    queries share their hits. So a vector that a third of the rows have is one row here.
    """
    kind = ["vec"] if width is None else ["indices", "values"]
    name = F.sha2(F.concat_ws(";", *[F.concat_ws(",", F.col(c).cast("array<string>")) for c in kind]), 256)
    few = k + 1
    turn = F.row_number().over(W.partitionBy("name").orderBy("id"))
    named = corpus.withColumn("name", name).withColumn("turn", turn).where(F.col("turn") <= few)
    # equal rows go by their lowest id, so that ties between them go to it too
    # copies with vectors are removed when nothing reads them any more, those without stay
    whole, parts = [], []
    named = stage(named.withColumn("lowest", F.min("id").over(W.partitionBy("name"))), whole)
    asked = stage(queries.withColumn("name", name), parts)
    first = F.row_number().over(W.partitionBy("name").orderBy("id"))
    one = stage(asked.withColumn("turn", first).where("turn = 1").select(F.col("name").alias("id"), *kind))
    rows = named.where("turn = 1").select("id", *kind)
    named, asked = stage(named.select("lowest", "id")), stage(asked.select("id", "name"))
    release(corpus.sparkSession, parts)
    found = (
        cell_topk(rows, one, few)
        if width is None
        else block_topk(rows, one, few, passing=whole)
    )
    held = found.select(F.col("query_id").alias("asked"), F.col("id").alias("lowest"), "similarity")
    near = held.join(named.select("lowest", "id"), "lowest").select("asked", "id", "similarity")
    best = W.partitionBy("asked").orderBy(F.desc("similarity"), "id")
    near = near.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= few)
    hits = asked.select(F.col("id").alias("query_id"), F.col("name").alias("asked")).join(near, "asked")
    if exclude_self:
        hits = hits.where("query_id <> id")
    return _merge(hits.select("query_id", "id", "similarity"), k)


def _scan(
    corpus: DataFrame,
    queries: DataFrame,
    block: pa.Table,
    k: int,
    width: int | None,
    exclude_self: bool,
) -> DataFrame:
    schema = _hit_schema(queries.schema["id"].dataType, corpus.schema["id"].dataType)
    if block.num_rows == 0:
        return corpus.sparkSession.createDataFrame([], schema)
    batch = block.combine_chunks().to_batches()[0]
    # sparse queries travel as postings, never as rows as wide as the vocabulary
    kept = _matrix(batch) if width is None else Postings(SparseRows(batch))
    shared = corpus.sparkSession.sparkContext.broadcast((_ids(batch), kept))
    step = max(1, SCORE_CELLS // batch.num_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, kept = shared.value
        if width is None:
            near = Best(query_ids, k, exclude_self)
            for part in batches:
                _offer(near, kept, np.arange(len(kept)), _matrix(part), _ids(part))
            yield from near.table(to_arrow_schema(schema)).to_batches()
            return
        best = None
        for part in batches:
            for start in range(0, part.num_rows, step):
                rows = part.slice(start, step)
                scores = kept.scores(SparseRows(rows), 0, rows.num_rows).T
                found = best_of(query_ids, _ids(rows), scores, k, exclude_self)
                best = found if best is None else _keep(pd.concat([best, found]), k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return corpus.mapInArrow(score, schema)


def _offer(best: Best, queries: np.ndarray, places: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
    """Offer rows to the queries at some places, a tile of scores at a time."""
    if not len(rows):
        return
    margin = margin_of(rows.shape[1])
    across = min(len(ids), math.isqrt(SCORE_CELLS))
    down = max(1, SCORE_CELLS // across)
    for start in range(0, len(places), down):
        some = places[start : start + down]
        asked = queries[some]
        short = asked.astype("float32")
        for first in range(0, len(ids), across):
            held = rows[first : first + across]
            best.offer(
                some,
                ids[first : first + across],
                short @ held.astype("float32").T,
                margin,
                lambda at, to: np.einsum("ij,ij->i", asked[at], held[to]),
                lambda: asked @ held.T,
            )


def _block(blocks) -> F.Column:
    return F.pmod(F.xxhash64("id"), blocks).cast("int")


def _every(blocks) -> F.Column:
    return F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))


def _heaps(size: np.ndarray, rows_per_block: int) -> list[tuple[int, int, int, int]]:
    """``(first cell, last cell, first heap, heaps)``: cells side by side, as many as make one block of
    rows, lie in one heap; a cell of more rows is dealt to heaps of its own."""
    out, heap, first, held = [], 0, 0, 0
    for cell, n in enumerate(size.tolist()):
        if held and held + n > rows_per_block:
            out.append((first, cell, heap, 1))
            heap, first, held = heap + 1, cell, 0
        held += n
        if held > rows_per_block:
            own = math.ceil(held / rows_per_block)
            out.append((first, cell + 1, heap, own))
            heap, first, held = heap + own, cell + 1, 0
    if first < len(size):
        out.append((first, len(size), heap, 1))
    return out


def _cell_kernel(first_cell: dict[int, int], k: int, exclude_self: bool, schema: pa.Schema):
    """The k best rows of a heap for each query, which looks only into the cells it names."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        held, asking = (side.combine_chunks().to_batches()[0] for side in (left, right))
        cells = held.column("cell").to_numpy()
        order = np.argsort(cells, kind="stable")
        cells, rows, ids = cells[order], _matrix(held)[order], _ids(held)[order]
        queries = _matrix(asking)
        marks = np.frombuffer(b"".join(asking.column("cells").to_pylist()), dtype="uint8")
        wanted = np.unpackbits(marks.reshape(len(queries), -1), axis=1).astype(bool)
        least = asking.column("least").to_numpy(zero_copy_only=False)
        best = Best(_ids(asking), k, exclude_self, least)
        names, starts = np.unique(cells, return_index=True)
        ends, start = np.append(starts[1:], len(cells)), 0
        wanted = wanted[:, names - first_cell[held.column("heap")[0].as_py()]]
        for i, end in enumerate(ends):
            # neighbouring cells that the same queries search are one product
            if i + 1 == len(ends) or (wanted[:, i] != wanted[:, i + 1]).any():
                _offer(best, queries, np.flatnonzero(wanted[:, i]), rows[start:end], ids[start:end])
                start = end
        return best.table(schema)

    return kernel


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _cells_to_search(
    angles: np.ndarray, radius: np.ndarray, size: np.ndarray, k: int, bound: np.ndarray | None
) -> np.ndarray:
    """Which cells each query searches, from its angles to the pivots.

    Without a bound: the nearest cells that together hold more than ``k`` rows. With one:
    those others whose nearest possible member is no farther than the bound.
    """
    least = np.maximum(angles - radius, 0.0)
    least[:, size == 0] = np.inf
    order = np.argsort(least, axis=1, kind="stable")
    held = np.cumsum(size[order], axis=1)
    home = np.zeros_like(least, dtype=bool)
    np.put_along_axis(home, order, held - size[order] < k + 1, axis=1)
    if bound is None:
        return home & np.isfinite(least)
    return ~home & (least <= bound[:, None])


def cell_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 3,
    exclude_self: bool = False,
    cells: int | None = None,
    rows_per_block: int = 32_768,
    seed: int = 42,
) -> DataFrame:
    """Exact top-k of dense vectors for query sets of any size.

    Each corpus row joins the cell of its nearest pivot. A query first searches the cells
    nearest to it, which bounds its k-th similarity, and then only the cells whose nearest
    possible member lies within that bound. Cells side by side share a heap of about
    ``rows_per_block`` rows, a query goes once to every heap that holds cells it searches, with their
    names, and a full cell is dealt to several heaps, so a task holds one block of either side. ``cells`` defaults to the square root of the corpus size; only the
    size of the pivots, which every task holds, bounds it.
    """
    spark = corpus.sparkSession
    room = max(1, BROADCAST_BYTES // (8 * _width_of(corpus, None)))
    cells = min(cells or max(1, math.isqrt(corpus.count())), room)
    sample = exact_sample(corpus, "id", cells, seed).toArrow().combine_chunks()
    if sample.num_rows == 0:
        schema = _hit_schema(queries.schema["id"].dataType, corpus.schema["id"].dataType)
        return _merge(spark.createDataFrame([], schema), k)
    pivots = spark.sparkContext.broadcast(_matrix(sample.to_batches()[0]))
    n_cells = sample.num_rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(_matrix(batch), pivots.value)
            nearest = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("vec"),
                    pa.array(nearest.astype("int32")),
                    pa.array(angles[np.arange(len(nearest)), nearest]),
                ],
                names=["id", "vec", "cell", "angle"],
            )

    in_cells = T.StructType(
        [*corpus.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    )
    placed = stage(corpus.select("id", "vec").mapInArrow(place, in_cells))
    # One row per cell.
    stats = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
    radius, size = np.zeros(n_cells), np.zeros(n_cells, dtype="int64")
    for row in stats:
        radius[row["cell"]], size[row["cell"]] = row["radius"], row["n"]

    step = max(1, min(PROBE_ROWS, SCORE_CELLS // n_cells))
    heaps = _heaps(size, rows_per_block)
    first_cell = {heap: first for first, _, start, n in heaps for heap in range(start, start + n)}

    def probe(far: bool):
        """A row per query and heap that holds cells to search: the nearest ones, or the others within its bound."""

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    rows = batch.slice(start, step)
                    angles = _angles(_matrix(rows), pivots.value)
                    bound = rows.column("bound").to_numpy(zero_copy_only=False) if far else None
                    wanted = _cells_to_search(angles, radius, size, k, bound)
                    for first, last, heap, n in heaps:
                        at = np.flatnonzero(wanted[:, first:last].any(axis=1))
                        if not len(at):
                            continue
                        marks = np.packbits(wanted[at, first:last], axis=1)
                        marks = pa.array([mark.tobytes() for mark in marks], pa.binary())
                        taken = [rows.column(name).take(pa.array(at)) for name in ("id", "vec", "least")]
                        for own in range(heap, heap + n):
                            yield pa.RecordBatch.from_arrays(
                                [*taken, marks, pa.array(np.full(len(at), own, dtype="int32"))],
                                names=["id", "vec", "least", "cells", "heap"],
                            )

        return assign

    probed = T.StructType(
        [
            *queries.select("id", "vec").schema.fields,
            T.StructField("least", T.DoubleType()),
            T.StructField("cells", T.BinaryType()),
            T.StructField("heap", T.IntegerType()),
        ]
    )
    # one row per cell
    ranges = spark.createDataFrame(
        [(cell, heap, n) for first, last, heap, n in heaps for cell in range(first, last)],
        "cell int, start int, heaps int",
    )
    in_heaps = placed.join(F.broadcast(ranges), "cell").withColumn("heap", F.col("start") + _block(F.col("heaps")))
    schema = _hit_schema(queries.schema["id"].dataType, corpus.schema["id"].dataType)
    kernel = _cell_kernel(first_cell, k, exclude_self, to_arrow_schema(schema))

    def search(probes: DataFrame) -> DataFrame:
        counts = probes.groupBy("heap").count().collect()
        plan = spark.createDataFrame(
            [(r["heap"], math.ceil(r["count"] / rows_per_block)) for r in counts], "heap int, qbs int"
        )
        # At most one row per heap, and no more heaps than cells and full blocks.
        plan = F.broadcast(plan)
        left = in_heaps.join(plan, "heap").select("heap", _every(F.col("qbs")).alias("qb"), "id", "vec", "cell")
        right = probes.join(plan, "heap").select(
            "heap", _block(F.col("qbs")).alias("qb"), "id", "vec", "least", "cells"
        )
        return left.groupBy("heap", "qb").cogroup(right.groupBy("heap", "qb")).applyInArrow(kernel, schema)

    vectors = queries.select("id", "vec", F.lit(-math.inf).alias("least"))
    near = stage(_merge(search(vectors.mapInArrow(probe(False), probed)), k).drop("rank"))
    full = F.count("*") >= k
    bounds = near.groupBy(F.col("query_id").alias("id")).agg(
        F.when(full, F.acos(F.greatest(F.min("similarity") - 2 * 10.0**-DIGITS, F.lit(-1.0))))
        .otherwise(math.pi)
        .alias("bound"),
        F.when(full, F.min("similarity")).alias("least"),
    )
    bounded = vectors.drop("least").join(bounds, "id", "left").select(
        "id",
        "vec",
        F.coalesce("bound", F.lit(math.pi)).alias("bound"),
        F.coalesce("least", F.lit(-math.inf)).alias("least"),
    )
    more = search(stage(bounded).mapInArrow(probe(True), probed))
    return _merge(near.unionByName(more), k)
