"""K-means of many runs against plain Lloyd steps."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from parley.operators import clusters, kmeans


@pytest.fixture(scope="module")
def cloud(spark):
    rnd = np.random.default_rng(7)
    x = np.concatenate([rnd.normal(c, 0.3, (60, 4)) for c in np.eye(4) * 3])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    return x, rows.withColumn("features", array_to_vector("v")).repartition(5).cache()


def lloyd(x, centers, tol=1e-4):
    while True:
        cell = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[cell == j].mean(0) if (cell == j).any() else c for j, c in enumerate(centers)])
        far = np.sqrt(((new - centers) ** 2).sum(1)).max()
        centers = new
        if far <= tol:
            return centers, ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum()


def test_all_runs_equal_separate_ones(cloud):
    x, frame = cloud
    runs = [(k, seed) for k in (1, 2, 4, 7) for seed in range(4)]
    fits = kmeans.fit_runs(frame, runs)
    rows = frame.selectExpr("v AS x", "xxhash64(v) AS h").orderBy("h").collect()
    sample = np.array([r["x"] for r in rows])
    for (k, seed), fit in zip(runs, fits):
        centers, cost = lloyd(x, kmeans.starts(sample, k, seed))
        assert (fit.k, fit.seed) == (k, seed) and np.allclose(fit.centers, centers)
        assert fit.cost == pytest.approx(cost)


def test_best_of_restarts_finds_the_groups(cloud):
    x, frame = cloud
    fit = clusters.fit_kmeans(frame, 4, n_init=5)
    sizes = clusters.assign(frame, fit).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in sizes) == [60] * 4


def test_a_step_is_one_scan_for_all_runs(spark, cloud, monkeypatch):
    _, frame = cloud
    calls = []
    plain = kmeans.step
    monkeypatch.setattr(kmeans, "step", lambda rows, centers: calls.append(len(centers)) or plain(rows, centers))
    fits = kmeans.fit_runs(frame, [(k, s) for k in (2, 3, 5) for s in range(10)])
    assert len(calls) == max(f.steps for f in fits) + 1 and calls[0] == 30


def test_few_and_equal_rows(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "id long, v array<double>")
    frame = rows.withColumn("features", array_to_vector("v"))
    fit = kmeans.fit_runs(frame, [(3, 1)])[0]
    assert fit.cost == 0 and fit.centers.shape == (3, 2)
    assert {r["cluster"] for r in clusters.assign(frame, fit).collect()} == {0}
    with pytest.raises(ValueError):
        kmeans.fit_runs(frame.limit(0), [(2, 1)])


def test_silhouette_estimate_holds_the_exact_one(spark, cloud):
    x, frame = cloud
    rows = frame.selectExpr("id", "v", "CAST(id DIV 60 AS INT) AS l", "CAST(id % 3 AS INT) AS other")
    for label in ("l", "other"):
        exact = clusters.silhouette(rows, "id", "v", [label]).first()["silhouette"]
        whole = clusters.silhouette_estimate(rows, "id", "v", label).first()
        assert whole["n"] == 240 and whole["silhouette"] == pytest.approx(exact, abs=2e-6)
        assert whole["low"] == whole["silhouette"] == whole["high"]
        for seed in range(3):
            part = clusters.silhouette_estimate(rows, "id", "v", label, per_label=40, seed=seed).first()
            assert part["low"] <= exact <= part["high"] and part["low"] < part["high"]
            assert part["silhouette"] == pytest.approx(exact, abs=0.1)


def test_silhouette_estimate_of_few_rows(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [0.0, 2.0], 1), (4, None, 1), (5, [1.0, 1.0], None)],
        "id long, v array<double>, l int",
    )
    exact = clusters.silhouette(rows.where("id < 4"), "id", "v", ["l"]).first()["silhouette"]
    assert clusters.silhouette_estimate(rows, "id", "v", "l").first()["silhouette"] == pytest.approx(exact)
    assert clusters.silhouette_estimate(rows.limit(0), "id", "v", "l").count() == 0
    one = clusters.silhouette_estimate(rows.where("l = 1 and id < 4"), "id", "v", "l").first()
    assert one["silhouette"] == 0.0 == clusters.silhouette(rows.where("l = 1 and id < 4"), "id", "v", ["l"]).first()["silhouette"]


def test_a_step_sends_one_row_to_the_driver(cloud, monkeypatch):
    x, frame = cloud
    points = frame.selectExpr("v AS x").repartition(12)
    sent, plain = [], type(points).collect
    monkeypatch.setattr(type(points), "collect", lambda self: sent.append(plain(self)) or sent[-1])
    (_, counts, _), = kmeans.step(points, [np.eye(3, x.shape[1])])
    assert counts.sum() == 240 and [len(rows) for rows in sent] == [1]


@pytest.mark.parametrize("cells", [100, 4_000_000])
def test_silhouette_tiles_and_missing_labels(cloud, monkeypatch, cells):
    _, frame = cloud
    rows = frame.selectExpr("id", "v", "CAST(id % 3 AS INT) AS l", "CAST(if(id < 9, NULL, id DIV 60) AS INT) AS other")
    whole = {r["labeling"]: r for r in clusters.silhouette(rows, "id", "v", ["l", "other"], rows_per_block=50).collect()}
    monkeypatch.setattr(clusters, "SCORE_CELLS", cells)
    tiled = {r["labeling"]: r for r in clusters.silhouette(rows, "id", "v", ["l", "other"]).collect()}
    assert tiled == whole and whole["l"]["n"] == 240


def test_rows_of_a_silhouette_travel_a_few_times(cloud):
    """Six hundred thousand rows make no more than twenty blocks."""
    import inspect

    assert 615_384 / inspect.signature(clusters.silhouette).parameters["rows_per_block"].default < 20


def test_steps_read_even_blocks_of_kept_rows(spark, cloud, monkeypatch):
    """One partition of vectors is dealt to all cores, as plain doubles, and kept while runs move."""
    x, frame = cloud
    monkeypatch.setattr(kmeans, "BLOCK_BYTES", 8 * 4 * 7)  # seven rows in a block
    seen, plain = [], kmeans.step
    monkeypatch.setattr(kmeans, "step", lambda points, centers: seen.append(points) or plain(points, centers))
    fit = kmeans.fit_runs(frame.coalesce(1), [(4, 1)])[0]
    blocks = seen[0]
    assert all(points is blocks for points in seen) and not blocks.frame.is_cached
    parts = [sum(len(r["x"]) for r in part) // 32 for part in blocks.frame.select("x").rdd.glom().collect()]
    assert len(parts) == blocks.parts == spark.sparkContext.defaultParallelism
    assert sum(parts) == 240 and max(parts) < 80
    sample = np.array([r["v"] for r in frame.selectExpr("v", "xxhash64(v) AS h").orderBy("h").collect()])
    assert np.allclose(fit.centers, lloyd(x, kmeans.starts(sample, 4, 1))[0])


def test_blocks_beyond_the_heaps(spark, cloud):
    x, frame = cloud
    points = frame.selectExpr("v AS x")
    centers = [np.eye(3, x.shape[1]), np.eye(4, x.shape[1]) * 3]
    plain, blocks = kmeans.step(points, centers), kmeans.in_blocks(points, x.shape[1])
    many = kmeans.Blocks(blocks.frame.repartition(20), 20)
    for got in (kmeans.step(blocks, centers), kmeans.step(many, centers)):
        for (sums, counts, cost), (own_sums, own_counts, own_cost) in zip(plain, got):
            assert np.allclose(sums, own_sums) and np.array_equal(counts, own_counts) and np.isclose(cost, own_cost)
