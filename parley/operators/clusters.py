"""Clustering of message vectors and measures of a clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.functions import vectors as vx
from parley.operators.kmeans import Fit, cell_of, fit_runs
from parley.operators.sampling import exact_sample
from parley.session import stage

BROADCAST_BYTES = 64 * 1024 * 1024
SCORE_CELLS = 4_000_000  # distances held at once by one task


def features(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Add the unit vector as an ML vector column ``features``; a zero vector stays zero."""
    raw = df.withColumn("_raw", array_to_vector(vx.as_doubles(F.col(vec))))
    scaled = Normalizer(p=2.0, inputCol="_raw", outputCol="_unit").transform(raw)
    return scaled.withColumn("features", F.col("_unit")).drop("_raw", "_unit")


def fit_many(
    df: DataFrame, ks: Sequence[int], seed: int = 42, n_init: int = 10, max_iter: int = 300
) -> dict[int, Fit]:
    """Per k the best of ``n_init`` seeded runs by cost; all runs share every pass over the rows."""
    runs = [(k, seed + i) for k in ks for i in range(n_init)]
    best: dict[int, Fit] = {}
    for found in fit_runs(df, runs, max_iter=max_iter):
        if found.k not in best or found.cost < best[found.k].cost:
            best[found.k] = found
    return best


def fit_kmeans(df: DataFrame, k: int = 7, **options) -> Fit:
    return fit_many(df, [k], **options)[k]


def assign(df: DataFrame, model: Fit, column: str = "cluster") -> DataFrame:
    return df.withColumn(column, cell_of("features", model))


def cluster(df: DataFrame, vec: str = "embedding", k: int = 7, **options) -> DataFrame:
    """Rows with their cluster."""
    points = features(df, vec)
    return assign(points, fit_kmeans(points, k, **options)).drop("features")


def sweep(
    df: DataFrame,
    key: str,
    vec: str = "embedding",
    ks: Sequence[int] = range(3, 13),
    sample_size: int = 2000,
    seed: int = 42,
    **options,
) -> DataFrame:
    """``(k, inertia, silhouette)`` per number of clusters.

    Inertia is over all rows, the silhouette over one seeded sample of ``silhouette_rows``
    rows that all k share.
    """
    points = features(df, vec)
    kept = points.select(key, "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = fit_many(kept, list(ks), seed=seed, **options)
        labelled = exact_sample(kept, key, sample_size, seed)
        labelled = labelled.withColumn(vec, vector_to_array("features"))
        for k, model in models.items():
            labelled = assign(labelled, model, f"k{k}")
        costs = [(k, float(m.cost)) for k, m in models.items()]
        scores = {
            r["labeling"]: (r["silhouette"], r["n"])
            for r in silhouette(labelled, key, vec, [f"k{k}" for k in ks]).collect()
        }
    finally:
        kept.unpersist()
    rows = [(k, cost, *scores.get(f"k{k}", (None, 0))) for k, cost in costs]
    schema = "k int, inertia double, silhouette double, silhouette_rows bigint"
    return df.sparkSession.createDataFrame(rows, schema)


def best_k(swept: DataFrame) -> DataFrame:
    return swept.agg(
        F.max_by("k", "silhouette").alias("k"), F.max("silhouette").alias("silhouette")
    )


def centroids(df: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """Mean unit vector per label, by partial sums of whole vectors."""
    return (
        features(df, vec)
        .groupBy(label)
        .agg(Summarizer.mean(F.col("features")).alias("m"), F.count("*").alias("n"))
        .select(label, "n", vector_to_array("m").alias("centroid"))
    )


def inertia(df: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """Sum of squared distances to the centroids, in one pass.

    Uses sum |x - c|^2 = sum |x|^2 - n |c|^2 per label.
    """
    points = features(df, vec).withColumn("squared", F.pow(vx.norm(vx.unit(F.col(vec))), 2))
    per_label = points.groupBy(label).agg(
        Summarizer.mean(F.col("features")).alias("m"),
        F.count("*").alias("n"),
        F.sum("squared").alias("squared"),
    )
    center = vector_to_array("m")
    return per_label.agg(
        F.count("*").alias("labels"),
        F.sum("n").alias("n"),
        F.round(F.sum(F.col("squared") - F.col("n") * vx.dot(center, center)), 6).alias("inertia"),
    )


def representatives(
    df: DataFrame, key: str, label: str, vec: str = "embedding", n: int = 3, digits: int = 6
) -> DataFrame:
    """The ``n`` rows per label with the largest dot product with its centroid."""
    # Staged, so the planner knows the centroids' size and broadcasts them when they are few.
    centers = stage(centroids(df, label, vec).select(label, "centroid"))
    scored = df.join(centers, label).select(
        label,
        key,
        F.round(vx.dot(vx.unit(F.col(vec)), F.col("centroid")), digits).alias("score"),
    )
    order = W.partitionBy(label).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def silhouette(
    df: DataFrame, key: str, vec: str, labels: Sequence[str], rows_per_block: int = 32_768
) -> DataFrame:
    """Mean Euclidean silhouette per label column: ``(labeling, n, silhouette)``.

    The measure needs every pair's distance. Rows are hashed into blocks, each pair of
    blocks meets in one task, ``SCORE_CELLS`` distances at a time, and what leaves it is a sum per row and
    label, not pairs. A row travels once per block of ``rows_per_block`` rows.
    Work still grows with the square of the rows: score a sample of a large table, as
    :func:`sweep` does, or use :func:`squared_silhouette`.
    """
    blocks = max(1, math.ceil(df.count() / rows_per_block))
    columns = [F.col(name).cast("int").alias(f"l{i}") for i, name in enumerate(labels)]
    base = df.select(F.col(key).alias("id"), vx.unit(F.col(vec)).alias("vec"), *columns)
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = base.select("*", mine.alias("a"), other.alias("b"))
    right = base.select("*", mine.alias("b"), other.alias("a"))
    names = list(labels)

    kind = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("labeling", T.StringType()),
            T.StructField("id", kind),
            T.StructField("own", T.IntegerType()),
            T.StructField("label", T.IntegerType()),
            T.StructField("total", T.DoubleType()),
            T.StructField("n", T.DoubleType()),
        ]
    )
    out = to_arrow_schema(schema)

    def rows_of(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        vec = side.column("vec").combine_chunks()
        flat = vec.flatten().to_numpy(zero_copy_only=False)
        return side.column("id").to_numpy(), flat.reshape(side.num_rows, -1)

    def sums(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return out.empty_table()
        (ids, p), (others, q) = rows_of(x), rows_of(y)
        squares, step = (q * q).sum(1)[None, :], max(1, SCORE_CELLS // len(q))
        at = pd.Index(others).get_indexer(ids)
        hot, found, spans = [], [], []
        for i in range(len(names)):
            values, code = np.unique(y.column(f"l{i}").to_numpy(), return_inverse=True)
            one_hot = np.zeros((len(q), len(values)))
            one_hot[np.arange(len(q)), code] = 1.0
            spans.append(slice(sum(map(len, found)), sum(map(len, found)) + len(values)))
            hot.append(one_hot)
            found.append(values)
        every_label = np.hstack(hot)
        totals, held = np.empty((len(p), every_label.shape[1])), every_label.sum(0)
        for start in range(0, len(p), step):
            part = p[start : start + step]
            distances = part @ q.T
            distances *= -2
            distances += (part * part).sum(1)[:, None]
            distances += squares
            np.sqrt(np.maximum(distances, 0.0, out=distances), out=distances)
            same = at[start : start + step]
            distances[np.flatnonzero(same >= 0), same[same >= 0]] = 0.0
            totals[start : start + step] = distances @ every_label
        tables = [
            pa.Table.from_pydict(
                {
                    "labeling": np.repeat(name, len(p) * len(values)),
                    "id": np.repeat(ids, len(values)),
                    "own": pa.array(np.repeat(x.column(f"l{i}").to_numpy(), len(values)), pa.int32(), from_pandas=True),
                    "label": pa.array(np.tile(values, len(p)), pa.int32(), from_pandas=True),
                    "total": totals[:, span].ravel(),
                    "n": np.tile(held[span], len(p)),
                },
                schema=out,
            )
            for i, (name, values, span) in enumerate(zip(names, found, spans))
        ]
        return pa.concat_tables(tables)

    partial = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(sums, schema)
    per_label = partial.groupBy("labeling", "id", "own", "label").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")
    )
    is_own = F.col("label") == F.col("own")
    per_row = per_label.groupBy("labeling", "id").agg(
        F.max(F.when(is_own, F.col("n"))).alias("own_n"),
        F.max(F.when(is_own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~is_own, F.col("total") / F.col("n"))).alias("b"),
    )
    value = F.when(F.col("own_n") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return per_row.groupBy("labeling").agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("silhouette")
    )


def silhouette_estimate(
    df: DataFrame,
    key: str,
    vec: str,
    label: str,
    per_label: int = 1000,
    delta: float = 0.01,
    seed: int = 42,
) -> DataFrame:
    """``(labeling, n, silhouette, low, high)`` in one pass: distances to sampled rows only.

    Every row meets at most ``per_label`` rows of each label, drawn by a hash of key and seed, so the work grows
    with the rows. Distances of unit vectors lie in [0, 2]; by the Hoeffding-Serfling bound all mean
    distances of all rows lie within their margins at once but for a chance of ``delta``, and the exact
    silhouette then lies between ``low`` and ``high``. Labels that are sampled whole have no margin. The
    samples are broadcast; if they exceed ``BROADCAST_BYTES``, fewer rows per label are drawn.
    """
    rows = df.select(F.col(key).alias("id"), vx.unit(F.col(vec)).alias("vec"), F.col(label).cast("int").alias("own"))
    rows = rows.where("own is not null and vec is not null")
    facts = rows.groupBy("own").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"))
    sizes = {r["own"]: (r["n"], r["width"]) for r in facts.toLocalIterator()}  # one row per label
    schema = "labeling string, n bigint, silhouette double, low double, high double"
    if not sizes:
        return df.sparkSession.createDataFrame([], schema)
    most = BROADCAST_BYTES // (8 * len(sizes) * max(width for _, width in sizes.values()))
    if most < 2:
        raise ValueError(f"{len(sizes)} labels are too many for samples of {BROADCAST_BYTES} bytes")
    turn = F.row_number().over(W.partitionBy("own").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    drawn = rows.withColumn("turn", turn).where(F.col("turn") <= min(per_label, most)).drop("turn").toPandas()
    names = np.array(sorted(sizes))
    code = np.searchsorted(names, drawn["own"].to_numpy())
    one_hot = np.zeros((len(drawn), len(names)))
    one_hot[np.arange(len(drawn)), code] = 1.0
    total = np.array([sizes[name][0] for name in names], float)
    held, n = one_hot.sum(0), total.sum()
    spread = np.log(2 * n * len(names) / delta) / (2 * held)
    margin = 2 * np.sqrt(np.maximum(1 - (held - 1) / total, 0) * spread) * (held < total)
    shared = df.sparkSession.sparkContext.broadcast(
        (np.vstack(drawn["vec"].to_list()), pd.Index(drawn["id"]), names, one_hot, held, total, margin)
    )

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample, ids, names, one_hot, held, total, margin = shared.value
        squares = (sample * sample).sum(1)[None, :]
        for batch in batches:
            step = max(1, SCORE_CELLS // len(sample))
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                x = np.vstack(part["vec"].to_list())
                gaps = np.sqrt(np.maximum((x * x).sum(1)[:, None] + squares - 2 * (x @ sample.T), 0.0))
                at = ids.get_indexer(part["id"])
                gaps[np.flatnonzero(at >= 0), at[at >= 0]] = 0.0
                sums, own = gaps @ one_hot, np.searchsorted(names, part["own"].to_numpy())
                every = np.arange(len(part))
                others = np.maximum(held[own] - (at >= 0), 1)
                a, apart = sums[every, own] / others, margin[own]
                means = sums / held
                means[every, own] = np.inf

                def value(a, b):
                    a, b = np.maximum(a, 0.0), np.maximum(b, 0.0)
                    top = np.maximum(a, b)
                    return np.where(top > 0, (b - a) / np.where(top > 0, top, 1.0), 0.0)

                alone = (total[own] == 1) | np.isinf(means).all(1)
                found = {
                    "silhouette": value(a, means.min(1, initial=2.0)),
                    "low": value(a + apart, (means - margin).min(1, initial=2.0)),
                    "high": value(a - apart, (means + margin).min(1, initial=2.0)),
                }
                yield pd.DataFrame({k: np.where(alone, 0.0, v) for k, v in found.items()})

    values = rows.mapInPandas(scored, "silhouette double, low double, high double")
    return values.agg(
        F.lit(label).alias("labeling"),
        F.count("*").alias("n"),
        *[F.round(F.avg(c), 6).alias(c) for c in ("silhouette", "low", "high")],
    )


def squared_silhouette(df: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """Silhouette on squared distances: linear in the rows, a different number."""
    points = features(df, vec).withColumn("_label", F.col(label).cast("double"))
    score = ClusteringEvaluator(featuresCol="features", predictionCol="_label").evaluate(points)
    return df.sparkSession.createDataFrame([(float(score),)], "squared_silhouette double")


def project_2d(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """First two principal components of the centred unit vectors.

    ``explained_pct`` is the variance share of both; a component's sign makes its largest
    loading positive.
    """
    points = features(df, vec)
    center = StandardScaler(
        withMean=True, withStd=False, inputCol="features", outputCol="centred"
    ).fit(points)
    centred = center.transform(points)
    model = PCA(k=2, inputCol="centred", outputCol="pc").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), [0, 1]])
    explained = float(model.explainedVariance.toArray().sum() * 100)
    pc = vector_to_array("pc")
    return model.transform(centred).select(
        key,
        F.round(pc[0] * float(signs[0]), 6).alias("pc1"),
        F.round(pc[1] * float(signs[1]), 6).alias("pc2"),
        F.lit(round(explained, 2)).alias("explained_pct"),
    )
