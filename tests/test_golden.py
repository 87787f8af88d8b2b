"""Published numbers on the 210 hand-audited messages."""

import pytest
from pyspark.sql import functions as F

from parley import schemas
from parley.functions import text as tx
from parley.operators import evaluate, profile, rules, sampling, systems
from parley.plans import evaluation, labelling
from parley.sources.tables import read_csv


@pytest.fixture(scope="module")
def sheet(spark, messages_path):
    rows = read_csv(spark, messages_path, schemas.GOLDEN_SET).coalesce(1)
    # The file's row order, which the annotation sheet follows.
    return rows.withColumn("position", F.monotonically_increasing_id()).cache()


@pytest.fixture(scope="module")
def audited(sheet):
    return labelling.audited(labelling.labelled(sheet), "acme").cache()


def test_input_shape(sheet):
    assert sheet.columns[0] == "conversation_id"
    assert sheet.count() == 210
    pairs = profile.value_counts(sheet, "cluster", "intent_label").collect()
    assert sorted(r["n"] for r in pairs) == [30] * 7
    named = rules.code_label(F.col("cluster"), rules.CLUSTER_INTENTS)
    assert sheet.where(named != F.col("intent_label")).count() == 0


def test_rule_labels(sheet):
    flags = labelling.labelled(sheet).groupBy("is_escalation").count().collect()
    assert {r[0]: r[1] for r in flags} == {True: 72, False: 138}


def test_audit(audited):
    flags = {r[0]: r[1] for r in audited.groupBy("is_escalation").count().collect()}
    assert flags == {True: 74, False: 136}
    counts = {r["audit_branch"]: r["rows_changed"] for r in rules.change_counts(audited).collect()}
    assert {b: n for b, n in counts.items() if n} == {1: 2, 2: 1, 3: 2, 4: 1}
    intents = {r[0]: r[1] for r in audited.groupBy("intent_label").count().collect()}
    assert intents == {
        "account_access": 32,
        "app_bug": 32,
        "billing_dispute": 31,
        "feature_request": 28,
        "general_inquiry": 29,
        "off_topic_chatter": 28,
        "subscription_issue": 30,
    }


def test_second_opinion_rows_in_order(spark, audited, second_opinion_path):
    wanted = read_csv(spark, second_opinion_path, schemas.HUMAN_BENCHMARK).coalesce(1).collect()
    picked = labelling.annotation_sheet(audited, "position").orderBy("pick").collect()
    assert [r["conversation_id"] for r in picked] == [r["conversation_id"] for r in wanted]
    assert [r["intent_label"] for r in picked] == [r["intent_label"] for r in wanted]
    assert [str(r["is_escalation"]) for r in picked] == [r["is_escalation"] for r in wanted]
    assert [r["label_notes"] for r in picked] == [r["label_notes"] for r in wanted]


def test_text_flags_are_parsed(spark, second_opinion_path):
    rows = read_csv(spark, second_opinion_path, schemas.HUMAN_BENCHMARK)
    parsed = labelling.with_parsed_flag(rows)
    counts = {r[0]: r[1] for r in parsed.groupBy("is_escalation").count().collect()}
    assert counts == {True: 10, False: 20}
    first = sampling.preview(parsed, "conversation_id", 3).collect()
    assert len(first) == 3 and first[0]["conversation_id"] <= first[1]["conversation_id"]


def test_second_opinion_is_valid(spark, second_opinion_path):
    rows = read_csv(spark, second_opinion_path, schemas.HUMAN_BENCHMARK)
    assert labelling.annotation_checks(rows).count() == 0
    assert labelling.label_checks(rows).count() == 0
    # Constant grades leave nothing to agree on beyond chance.
    row = evaluate.kappa(rows, "human_target_tone", "human_target_accuracy").first()
    assert row["kappa"] is not None
    same = evaluate.kappa(rows, "human_target_tone", "human_target_tone").first()
    assert same["kappa"] is None and same["agreement_pct"] == 100.0


def test_keyword_and_constant_scores(audited):
    answers = audited.select(
        "conversation_id",
        F.lit("keywords").alias("system"),
        F.lit("general_inquiry").alias("predicted_intent"),
        systems.keyword_decision(F.col("first_customer_text_clean"))["is_escalation"].alias(
            "is_escalation"
        ),
    )
    constant = systems.constant_answers(audited, "conversation_id", "general_inquiry").select(
        *answers.columns
    )
    scored = evaluation.with_truth(
        evaluate.systems_long([answers, constant]), audited, "conversation_id"
    )
    rows = {r["system"]: r for r in evaluate.system_metrics(scored).collect()}
    words = rows["keywords"]
    assert (words["tp"], words["fp"], words["fn"]) == (16, 0, 58)
    assert words["escalation_precision"] == 100.0
    assert words["escalation_recall"] == 21.62
    assert words["escalation_f1"] == 35.56
    fixed = rows["constant"]
    assert fixed["intent_accuracy"] == 13.81
    assert fixed["escalation_precision"] == fixed["escalation_f1"] == 0.0


def test_published_arithmetic(spark):
    cells = [(True, True, 68), (False, True, 3), (True, False, 6), (False, False, 133)]
    rows = [("x", "a", "a", t, p) for t, p, n in cells for _ in range(n)]
    frame = spark.createDataFrame(
        rows,
        "system string, true_intent string, predicted_intent string, "
        "true_escalation boolean, predicted_escalation boolean",
    )
    got = evaluate.system_metrics(frame).first()
    assert got["escalation_precision"] == 95.77
    assert got["escalation_recall"] == 91.89
    assert got["escalation_f1"] == 93.79


def test_word_counts(sheet):
    counts = sheet.select(tx.word_count(tx.clean_text(F.col("first_customer_text_clean"))).alias("n"))
    row = counts.agg(F.min("n"), F.max("n")).first()
    assert tuple(row) == (4, 50)


def test_labelling_sheet_is_stratified(sheet):
    drawn = labelling.labelling_sheet(sheet, per_cluster=5)
    sizes = [r["count"] for r in drawn.groupBy("cluster").count().collect()]
    assert sizes == [5] * 7
    again = labelling.labelling_sheet(sheet.repartition(7), per_cluster=5)
    assert [r[0] for r in drawn.collect()] == [r[0] for r in again.collect()]


def test_exact_sample_ignores_partitions(sheet):
    one = sampling.exact_sample(sheet, "conversation_id", 50).select("conversation_id")
    two = sampling.exact_sample(sheet.repartition(9), "conversation_id", 50).select("conversation_id")
    assert one.count() == 50
    assert sorted(one.collect()) == sorted(two.collect())
