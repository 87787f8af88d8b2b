"""Tables that grow with the documents are never broadcast, however small the planner takes them for."""

import random

from pyspark.sql import DataFrame

from parley.llm import components, nearcopies, repeats


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        own = list(base) if i % 2 else [f"v{rnd.randrange(900)}" for _ in range(120)]
        own[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def plans_of(monkeypatch, module, run):
    """The plans of everything that is staged, and of the result."""
    found, whole = [], module.stage

    def stage(df: DataFrame, *rest):
        found.append(planned(df))
        return whole(df, *rest)

    monkeypatch.setattr(module, "stage", stage)
    monkeypatch.setattr(components, "stage", stage)
    return found + [planned(df) for df in run()]


def test_near_copies(spark, monkeypatch):
    plans = plans_of(monkeypatch, nearcopies, lambda: [nearcopies.components_of(texts(spark))])
    joins = [p for p in plans if "Join" in p]
    # the sizes of loose groups, a row for each, are the one table left to the planner
    assert len(joins) > 5
    assert sum(p.count("BroadcastExchange") for p in joins) <= 1


def test_regions_come_out_of_an_explode(spark):
    rows = spark.range(1000).selectExpr("id as node", "explode(sequence(0, 31)) as tree")
    plan = planned(nearcopies._counted(rows.selectExpr("node", "tree", "node % 7 as region")))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_passages(spark, monkeypatch):
    plans = plans_of(monkeypatch, repeats, lambda: repeats.analyse(texts(spark), "doc_id", "text", 100, 32))
    assert sum("SortMergeJoin" in p for p in plans) > 2
    assert not any("Broadcast" in p for p in plans)
