"""Plans keep the shape that scale needs."""

from pyspark.sql import functions as F

from parley import catalog
from parley.operators import profile, sampling, threads
from parley.sources import tables

FOLDER = "/root/testdata/sf0.001"
FITTED = {
    "kmeans_assign", "k_sweep", "classify_intents", "pca_2d", "triage_prompts",
    "kmeans_facts", "pca_facts", "classifier_facts", "probability_facts", "stream_messages",
}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_registered_query_pairs_all_rows(spark):
    for name, query in catalog.QUERIES.items():
        if name not in FITTED:
            plan = plan_of(query(spark, FOLDER))
            assert "CartesianProduct" not in plan, name
            assert "BroadcastNestedLoopJoin" not in plan, name


def test_groups_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 2)
    for frame in (
        threads.keep_first(rows, "g", "id"),
        sampling.stratified_sample(rows, "g", "id", 30),
        sampling.first_per_group(rows, "g", "id"),
    ):
        plan = plan_of(frame)
        exchange = plan.index("Exchange hashpartitioning")
        assert "WindowGroupLimit" in plan[exchange:]


def test_samples_do_not_sort_everything(spark):
    plan = plan_of(sampling.exact_sample(spark.range(1000), "id", 10))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_cells_are_counted_before_the_cube(spark):
    rows = spark.range(100).selectExpr("id % 3 as a", "id % 2 as b")
    plan = plan_of(profile.crosstab(rows, "a", "b", (0, 1)))
    below_expand = plan[plan.index("Expand") :]
    assert "HashAggregate" in below_expand


def test_walk_reads_no_text(spark, tmp_path):
    tweets = spark.createDataFrame(
        [("1", "c", True, "t", "long text", "2", None), ("2", "brand", False, "t", "x", None, "1")],
        "tweet_id string, author_id string, inbound boolean, created_at string, text string, "
        "response_tweet_id string, in_response_to_tweet_id string",
    )
    pool = tables.stage_parquet(threads.brand_pool(tweets, "brand"), str(tmp_path / "pool"))
    plan = plan_of(threads.walk(pool, set_aside=()))
    assert "text#" not in plan and "text:string" not in plan
