"""K-means of many runs at once: every Lloyd step is one pass over the rows for all of them.

A step broadcasts the centres of all runs that still move. A task multiplies its rows with all
centres in one product, finds each run's nearest centre, and adds up rows and costs per run and
centre; only these sums are shuffled. Restarts and numbers of clusters therefore share every scan,
and the number of jobs is that of the longest run, not the sum over the runs. For the time of a fit
the rows are kept on the executors as blocks of plain doubles, dealt evenly to all cores.

Centres start from a k-means++ draw of each run on one sample of ``START_ROWS`` rows. A centre that
loses all rows stays where it is. The work of a step is rows x centres x length of a vector.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START_ROWS = 4096  # rows that the starting centres are drawn from
HEAPS = 16  # tasks that add up the partial sums of all others
CELLS = 2_000_000  # scores held at once by one task
BLOCK_BYTES = 1 << 20  # doubles of a block, but one row
PART_BYTES = 32 << 20  # doubles of a partition, about


@dataclass(frozen=True)
class Fit:
    """Centres of one run, one row each, and the sum of squared distances to them."""

    k: int
    seed: int
    centers: np.ndarray
    cost: float
    steps: int

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 - as pyspark.ml names it
        return list(self.centers)

    @property
    def summary(self) -> SimpleNamespace:
        return SimpleNamespace(trainingCost=self.cost, numIter=self.steps)


@dataclass(frozen=True)
class Blocks:
    """Rows ``x``, many in one binary value, and the number of partitions they are dealt to."""

    frame: DataFrame
    parts: int


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _matrices(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The rows of a column of vectors or of blocks."""
    if not pa.types.is_binary(column.type):
        yield _matrix(column)
        return
    for block in column:
        yield np.frombuffer(block.as_buffer()).reshape(-1, width)


def in_blocks(points: DataFrame, width: int) -> Blocks:
    """The rows ``x`` of a frame in blocks, dealt to all cores."""
    at_once = max(1, BLOCK_BYTES // (8 * width))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                body = _matrix(batch.column(0).slice(start, at_once)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["x"])

    cores = points.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-8 * width * points.count() // PART_BYTES))
    return Blocks(points.select("x").mapInArrow(packed, "x binary").repartition(parts), parts)


def starts(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """K-means++: each centre a row drawn by its squared distance to those before it."""
    rnd = np.random.default_rng(seed)
    chosen = [sample[rnd.integers(len(sample))]]
    gaps = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        total = gaps.sum()
        at = rnd.choice(len(sample), p=gaps / total) if total > 0 else rnd.integers(len(sample))
        chosen.append(sample[at])
        gaps = np.minimum(gaps, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every centre, less the row's own square."""
    return (centers**2).sum(1)[None, :] - 2 * (rows @ centers.T)


def step(
    points: DataFrame | Blocks, centers: Sequence[np.ndarray]
) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For every run the sums and counts of rows per nearest centre, and its cost; one pass."""
    parts, points = (points.parts, points.frame) if isinstance(points, Blocks) else (None, points)
    offsets = np.concatenate(([0], np.cumsum([len(c) for c in centers])))
    every, width = int(offsets[-1]), centers[0].shape[1]
    shared = points.sparkSession.sparkContext.broadcast(np.vstack(centers))  # one row per run and centre
    at_once = max(1, CELLS // every)
    runs = len(centers)

    def packed(sums: np.ndarray, counts: np.ndarray, costs: np.ndarray) -> pa.RecordBatch:
        body = np.concatenate((sums.ravel(), counts, costs)).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["body"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every_center = shared.value
        sums, counts, costs = np.zeros((every, width)), np.zeros(every), np.zeros(runs)
        for batch in batches:
            for rows in (m[i : i + at_once] for m in _matrices(batch.column(0), width) for i in range(0, len(m), at_once)):
                gaps, own = _nearest(rows, every_center), (rows**2).sum(1)
                places = np.arange(len(rows))
                member = np.zeros((len(rows), every))
                for run in range(runs):
                    mine = gaps[:, offsets[run] : offsets[run + 1]]
                    cell = mine.argmin(1)
                    member[places, offsets[run] + cell] = 1.0
                    costs[run] += np.maximum(mine[places, cell] + own, 0.0).sum()
                sums += member.T @ rows
                counts += member.sum(0)
        yield packed(sums, counts, costs)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for body in batch.column(0).to_pylist():
                own = np.frombuffer(body)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["body"])

    heaps = points.select("x").mapInArrow(summed, "body binary")
    if parts is None or parts > HEAPS:  # else one task adds up the sums of all others
        heaps = heaps.repartition(HEAPS, F.spark_partition_id()).mapInArrow(added, "body binary")
    total = np.zeros(every * width + every + runs)
    whole = heaps.repartition(1).mapInArrow(added, "body binary")
    for row in whole.collect():  # one row, whatever the number of tasks
        total += np.frombuffer(row["body"])
    sums, counts = total[: every * width].reshape(every, width), total[every * width : -runs]
    return [
        (sums[offsets[r] : offsets[r + 1]], counts[offsets[r] : offsets[r + 1]], float(total[-runs + r]))
        for r in range(runs)
    ]


def fit_runs(
    points: DataFrame,
    runs: Sequence[tuple[int, int]],
    features: str = "features",
    tol: float = 1e-4,
    max_iter: int = 300,
) -> list[Fit]:
    """One fit per ``(k, seed)``. The rows are read three times, and kept as blocks while runs move."""
    rows = points.select(vector_to_array(features).alias("x"))
    drawn = rows.orderBy(F.xxhash64("x"), "x").limit(START_ROWS).toArrow().combine_chunks()
    if drawn.num_rows == 0:
        raise ValueError("no rows to cluster")
    sample = _matrix(drawn.column(0).chunk(0))
    centers = [starts(sample, k, seed) for k, seed in runs]
    steps, moving = [0] * len(runs), list(range(len(runs)))
    blocks = in_blocks(rows, sample.shape[1])
    kept = blocks.frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(max_iter):
            if not moving:
                break
            still = []
            for run, (sums, counts, _) in zip(moving, step(blocks, [centers[r] for r in moving])):
                held = counts > 0
                new = centers[run].copy()
                new[held] = sums[held] / counts[held, None]
                far = np.sqrt(((new - centers[run]) ** 2).sum(1)).max()
                centers[run], steps[run] = new, steps[run] + 1
                if far > tol:
                    still.append(run)
            moving = still
        costs = [cost for *_, cost in step(blocks, centers)]
    finally:
        kept.unpersist()
    return [Fit(k, seed, c, cost, n) for (k, seed), c, cost, n in zip(runs, centers, costs, steps)]


def cell_of(features: str, fit: Fit):
    """Column of the nearest centre, the first of equally near ones."""
    centers = fit.centers

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        return pd.Series(_nearest(np.stack(vectors.to_numpy()), centers).argmin(1).astype("int32"))

    return nearest(vector_to_array(features))
