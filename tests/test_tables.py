import numpy as np
import pytest
from pyspark.sql import functions as F

from parley import schemas
from parley.operators import profile, quality, rules, sampling
from parley.sources import sinks, tables


def numbers(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@pytest.mark.parametrize(
    "values",
    [
        [1, 2, 3, 4],
        [5],
        [7] * 90 + list(range(40)),
        list(np.random.default_rng(1).normal(size=501)),
        list(range(1000)) + [None] * 500,
    ],
)
def test_describe_equals_numpy(spark, values):
    known = np.array([v for v in values if v is not None], dtype=float)
    row = profile.describe(numbers(spark, values).repartition(6), "x").first()
    assert row["n"] == len(known)
    assert row["mean"] == pytest.approx(known.mean(), abs=1e-5)
    assert (row["min"], row["max"]) == (known.min(), known.max())
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        assert row[name] == pytest.approx(np.quantile(known, q), abs=1e-5)
    if len(known) > 1:
        assert row["std"] == pytest.approx(known.std(ddof=1), abs=1e-5)


def test_histogram_closes_the_last_bin(spark):
    rows = profile.histogram(numbers(spark, list(range(21))), "x").collect()
    counts = {r["bin"]: r["n"] for r in rows}
    assert max(counts) == 20 and counts[20] == 2 and sum(counts.values()) == 21
    flat = profile.histogram(numbers(spark, [3, 3]), "x").collect()
    assert [(r["bin"], r["n"]) for r in flat] == [(1, 2)]


def test_crosstab(spark):
    rows = spark.createDataFrame(
        [("a", True), ("a", True), ("b", False), (None, True)], "k string, f boolean"
    )
    got = {r["k"]: (r["true"], r["false"], r["All"]) for r in _named(profile.crosstab(rows, "k", "f", (True, False)))}
    assert got == {"a": (2, 0, 2), "b": (0, 1, 1), "All": (2, 1, 3)}


def test_crosstab_margins_are_sums_of_cells(spark):
    """A row value that reads All, a column value that is not listed, nulls on both sides."""
    rows = spark.createDataFrame(
        [("All", "x"), ("a", "x"), ("a", "y"), ("a", "z"), (None, "x"), ("b", None), ("c", "z")],
        "k string, v string",
    )
    got = sorted(tuple(r) for r in profile.crosstab(rows, "k", "v", ("x", "y")).collect())
    assert got == [("All", False, 1, 0, 1), ("All", True, 2, 1, 3), ("a", False, 1, 1, 2)]


def test_order_statistics_are_never_missing(spark):
    values = [float(v) for v in range(1000)] + [500.0] * 3000
    frame = numbers(spark, values).repartition(7)
    got = profile.order_statistics(frame, "x", (0.0, 0.1, 0.5, 0.93, 1.0)).first()
    assert list(got) == [pytest.approx(np.quantile(values, q)) for q in (0.0, 0.1, 0.5, 0.93, 1.0)]
    assert list(profile.order_statistics(numbers(spark, []), "x", (0.5,)).first()) == [None]


def test_counts_drop_nulls_unless_asked(spark):
    rows = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert [tuple(r) for r in profile.shares(rows, "k").collect()] == [("a", 2, 100.0)]
    assert {tuple(r) for r in profile.shares(rows, "k", nulls=True).collect()} == {("a", 2, 66.7), (None, 1, 33.3)}


def _named(frame):
    return frame.withColumnsRenamed({"True": "true", "False": "false"}).collect()


def test_counts_and_shares(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert profile.mode(rows, "k").first()[0] == "a"
    got = {r["k"]: r["share_pct"] for r in profile.shares(rows, "k").collect()}
    assert got == {"a": 66.7, "b": 33.3}
    kept = profile.kept_share(rows.where("k = 'a'"), rows).first()
    assert (kept["kept"], kept["total"], kept["kept_pct"]) == (2, 3, 66.7)


def test_first_per_group(spark):
    rows = spark.createDataFrame(
        [(i, g) for i, g in enumerate("bbbbbbaaac")], "i int, g string"
    )
    got = sampling.first_per_group(rows, "g", "i", per_group=2, total=7).orderBy("pick").collect()
    assert [(r["g"], r["i"]) for r in got] == [
        ("b", 0), ("b", 1), ("a", 6), ("a", 7), ("c", 9), ("b", 2), ("b", 3),
    ]


def test_violations(spark):
    rows = spark.createDataFrame(
        [("1", "app_bug", "True", "ok"), ("2", "nope", "yes", " "), ("3", None, None, None)],
        "conversation_id string, intent_label string, is_escalation string, t string",
    )
    found = quality.label_violations(
        rows, "conversation_id", {"intent_label": rules.INTENTS}, ("is_escalation",), ("t",)
    )
    got = {(r["row_key"], r["rule"]) for r in found.collect()}
    kinds = ("domain_intent_label", "flag_is_escalation", "blank_t")
    assert got == {(k, rule) for k in ("2", "3") for rule in kinds}
    verdict = quality.verdict(found).first()
    assert (verdict["violations"], verdict["passed"]) == (6, False)
    assert quality.first_violations(found, 2).count() == 2


def test_missing_column(spark):
    rows = spark.createDataFrame([("1",)], "conversation_id string")
    found = quality.label_violations(rows, "conversation_id", {"intent_label": ("a",)}).collect()
    assert [r["message"] for r in found] == ["Missing required column: 'intent_label'"]


def test_unfilled_rows_skip_the_domain_checks(spark):
    rows = spark.createDataFrame(
        [("1", "", "bad"), ("2", "good", "bad"), ("3", "good", "fine")], "k string, a string, b string"
    )
    domains = {"a": ("good",), "b": ("fine",)}
    got = {(r["row_key"], r["rule"]) for r in quality.annotation_violations(rows, "k", domains).collect()}
    assert got == {("1", "unfilled"), ("2", "domain_b")}
    blank = quality.unfilled_fields(rows, "k", ("a", "b")).collect()
    assert [(r["row_key"], r["fields"]) for r in blank] == [("1", "a")]


def test_coverage_and_row_count(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(2,), (3,), (4,)], "k int")
    row = quality.coverage(left, right, "k").first()
    assert tuple(row) == (1, 1, 2)
    assert quality.row_count_warning(left, 2).count() == 0
    assert quality.row_count_warning(left, 210).first()["message"] == "Row count is 2, expected 210."


def labelled(spark, *rows):
    return spark.createDataFrame(
        list(rows),
        "first_customer_text_clean string, intent_label string, is_escalation boolean, label_notes string",
    )


def test_first_rule_wins_and_quotes(spark):
    rows = spark.createDataFrame(
        [("I was hacked, want a refund", "app_bug"), ("can't log in", "app_bug"),
         ("can’t log in", "app_bug"), (None, None)],
        "first_customer_text_clean string, intent_label string",
    )

    def notes(**options):
        out = rules.apply_rules(rows, rules.SUPPORT_RULES, rules.SUPPORT_DEFAULT, **options)
        return [(r["is_escalation"], r["label_notes"].split(":")[0]) for r in out.collect()]

    assert notes() == [
        (True, "Security/Hijack"), (True, "Account Access"), (False, "Technical Bug"), (False, "Default"),
    ]
    assert notes(normalize_quotes=True)[2] == (True, "Account Access")


def test_audit_branch_takes_the_row_without_changing_it(spark):
    rows = labelled(spark, ("App crash after update", "off_topic_chatter", True, "n"))
    row = rules.audit(rows, rules.support_audit("acme")).first()
    assert (row["intent_label"], row["is_escalation"], row["label_notes"]) == ("off_topic_chatter", True, "n")
    assert (row["audit_branch"], row["changed"]) == (3, False)
    other = labelled(spark, ("is acme down", "off_topic_chatter", True, "n"))
    row = rules.audit(other, rules.support_audit("acme")).first()
    assert (row["intent_label"], row["is_escalation"], row["changed"]) == ("app_bug", False, True)


def test_csv_round_trip_with_mark(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1", 'says "hi",\nthen', 3, True, 4)], schemas.CUSTOMER_MESSAGES
    )
    path = str(tmp_path / "out")
    sinks.write_csv(rows, path, bom=True)
    raw = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfconversation_id")
    back = tables.read_csv(spark, path, schemas.CUSTOMER_MESSAGES)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in rows.collect()]


def test_tweets_keep_their_ids_as_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
        '007,115,True,now,"a ""b""\nc","8,9",\n'
    )
    row = tables.read_tweets(spark, str(tmp_path / "t.csv")).first()
    assert row["tweet_id"] == "007" and row["inbound"] is True
    assert row["text"] == 'a "b"\nc' and row["in_response_to_tweet_id"] is None


def test_parquet_stage_prunes_columns(spark, tmp_path):
    rows = spark.createDataFrame([("1", "t", 2, True, 1)], schemas.CUSTOMER_MESSAGES)
    staged = tables.stage_parquet(rows, str(tmp_path / "p"))
    plan = staged.select("num_turns")._jdf.queryExecution().executedPlan().toString()
    assert "first_customer_text_clean" not in plan


def test_bucketed_table_joins_without_a_shuffle_of_its_own(spark, tmp_path):
    rows = spark.range(100).selectExpr("cast(id as string) as tweet_id", "id as n")
    table = tables.stage_bucketed(rows, "bucketed_tweets", str(tmp_path / "b"), "tweet_id", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = table.join(table.select("tweet_id").where("n < 50"), "tweet_id", "left_semi")
        assert joined.count() == 50
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_tweets")


def test_report_and_keyed_table(spark, tmp_path):
    metrics = spark.createDataFrame(
        [("a", "f1", 12.345), ("b", "f1", None)], "system string, metric string, value double"
    )
    sinks.write_report(sinks.metric_lines(metrics), str(tmp_path / "r"))
    lines = next((tmp_path / "r").glob("part-*")).read_text().splitlines()
    assert lines[0].split() == ["a", "f1", "12.35"] and lines[1].split()[-1] == "n/a"
    schema = schemas.EMBEDDINGS
    path = str(tmp_path / "k")
    assert sinks.read_keyed(spark, path, schema).count() == 0
    sinks.append_keyed(spark.createDataFrame([("1", [1.0])], schema), path)
    assert sinks.read_keyed(spark, path, schema).count() == 1
    joined = tables.attach_vectors(
        spark.createDataFrame([("1", "x"), ("2", "y")], "conversation_id string, t string"),
        tables.read_vectors(spark, path),
        "conversation_id",
    )
    assert joined.count() == 1
