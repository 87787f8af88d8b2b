"""From clustered messages to an audited labelling set and its checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import grades
from parley.functions import text as tx
from parley.operators import quality, rules, sampling
from parley.sources.tables import blank_columns

ANNOTATION_DOMAINS: Mapping[str, Sequence[str]] = {
    "human_expected_escalation": grades.ESCALATION_GRADES,
    "human_target_accuracy": grades.ACCURACY_GRADES,
    "human_target_tone": grades.TONE_GRADES,
}


def labelling_sheet(clustered: DataFrame, key: str = "conversation_id", per_cluster: int = 30) -> DataFrame:
    """Rows to label: a stratified sample in seeded order, answer columns blank."""
    picked = sampling.stratified_sample(clustered, "cluster", key, per_cluster).drop("pick")
    named = picked.withColumn(
        "intent_label", rules.code_label(F.col("cluster"), rules.CLUSTER_INTENTS)
    )
    sheet = blank_columns(named, "is_escalation", "label_notes")
    return sampling.shuffled(sheet, key).drop("shuffle_key")


def labelled(sheet: DataFrame, rule_table=rules.SUPPORT_RULES) -> DataFrame:
    return rules.apply_rules(
        sheet.drop("is_escalation", "label_notes"), rule_table, rules.SUPPORT_DEFAULT
    )


def audited(labelled_rows: DataFrame, brand: str) -> DataFrame:
    return rules.audit(labelled_rows, rules.support_audit(brand))


def annotation_sheet(audited_rows: DataFrame, order: str, total: int = 30) -> DataFrame:
    """Rows for a second opinion, with blank columns to fill."""
    picked = sampling.first_per_group(audited_rows, "intent_label", order, total=total)
    return blank_columns(picked, *ANNOTATION_DOMAINS, "human_qa_notes")


def label_checks(rows: DataFrame, key: str = "conversation_id") -> DataFrame:
    return quality.label_violations(
        rows,
        key,
        {"intent_label": rules.INTENTS},
        flags=("is_escalation",),
        texts=("first_customer_text_clean",),
    )


def annotation_checks(rows: DataFrame, key: str = "conversation_id") -> DataFrame:
    return quality.annotation_violations(rows, key, ANNOTATION_DOMAINS)


def with_parsed_flag(rows: DataFrame, flag: str = "is_escalation") -> DataFrame:
    return rows.withColumn(flag, tx.parse_flag(F.col(flag)))
