"""Answers by key: the history stays where it lies, and a batch that runs again asks nothing twice."""

import pytest
from pyspark.sql import functions as F

from parley.operators import enrich
from parley.streaming import triage


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def frames(spark, tmp_path):
    spark.range(5000).select(F.col("id").cast("string").alias("key")).write.parquet(str(tmp_path / "known"))
    requests = spark.range(4990, 5010).select(F.col("id").cast("string").alias("key"), F.lit("t").alias("text"))
    return requests, spark.read.parquet(str(tmp_path / "known"))


def test_a_small_set_of_requests_does_not_shuffle_the_history(spark, tmp_path, no_broadcasts, monkeypatch):
    requests, known = frames(spark, tmp_path)
    plan = enrich.answered(requests, known, "key")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(enrich, "BROADCAST_KEYS", 3)
    plan = enrich.answered(requests, known, "key")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan


@pytest.mark.parametrize("keys", [3, 1000])
def test_cached_and_uncached(spark, tmp_path, monkeypatch, keys):
    monkeypatch.setattr(enrich, "BROADCAST_KEYS", keys)
    requests, known = frames(spark, tmp_path)
    known = known.unionByName(known)  # an answer that was written twice
    twice = requests.unionByName(requests)
    assert sorted(r.key for r in enrich.cached(twice, known, "key").collect()) == sorted(map(str, [*range(4990, 5000)] * 2))
    assert sorted(r.key for r in enrich.uncached(twice, known, "key").collect()) == list(map(str, range(5000, 5010)))


def test_a_failed_batch_asks_nothing_twice(spark, tmp_path):
    calls, out = str(tmp_path / "calls"), str(tmp_path / "out")
    (tmp_path / "calls").mkdir()
    spark.range(30).select(F.col("id"), F.concat(F.lit("m"), "id").alias("text")).coalesce(2).write.parquet(str(tmp_path / "in"))

    def call(row):
        with open(f"{calls}/{row['key']}", "a") as file:
            file.write("x")
        return row["text"].upper()

    def run(path):
        stream = triage.read_messages(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, "*.parquet", 1)
        triage.answer_batches(stream, path, str(tmp_path / "state"), str(tmp_path / "store"), call, "id", "text").awaitTermination()

    (tmp_path / "blocked").write_text("a file where the rows should go")
    with pytest.raises(Exception):
        run(str(tmp_path / "blocked"))  # answers are written, the batch's rows are not
    first = {p.name for p in (tmp_path / "calls").iterdir()}
    assert first
    run(out)
    rows = {r.key: r.raw for r in spark.read.parquet(out).collect()}
    assert rows == {str(i): f"M{i}" for i in range(30)}
    assert {p.read_text() for p in (tmp_path / "calls").iterdir()} == {"x"}
