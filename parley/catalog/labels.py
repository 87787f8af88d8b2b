"""Registered queries on rule labels, the audit and keyword decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog import sql
from parley.operators import rules, systems
from parley.plans import labelling
from parley.sources import given
from parley.sources.given import table

# The given texts are invented prose, so a few rules on words it holds come first.
PROSE_RULES = (
    rules.Rule(True, "Abuse: insults need a moderator.", patterns=(r"\bworthless\b", r"\bidiots?\b")),
    rules.Rule(
        True, "Legal: license lines in app bugs.", patterns=(r"\blicense\b",), intents=("app_bug",)
    ),
    rules.Rule(False, "Legal: license lines elsewhere.", keywords=("license", "apache")),
)
PROSE_AUDIT = (
    rules.Branch(
        phrases=(("worthless", "scum"), ("trash", "idiot")),
        outcomes=(
            rules.Outcome(if_intents=("app_bug", "feature_request"), intent="off_topic_chatter",
                          escalate=True, note="Abuse: moved to chatter."),
            rules.Outcome(if_keywords=("license",), escalate=False, note="Abuse in a license text."),
        ),
    ),
)
BRAND = "acme"
KEYWORDS = ("trash", "idiot", "scum", "worthless", "license", "token", "account")
COLUMNS = ("conversation_id", "intent_label", "is_escalation", "label_notes")


def _labelled(spark, folder):
    return rules.apply_rules(
        given.messages(spark, folder), (*PROSE_RULES, *rules.SUPPORT_RULES), rules.SUPPORT_DEFAULT
    )


def _audited(spark, folder):
    branches = (*PROSE_AUDIT, *rules.support_audit(BRAND))
    return rules.audit(_labelled(spark, folder), branches)


def rule_labels(spark, folder):
    return _labelled(spark, folder).select(*COLUMNS)


def rule_audit(spark, folder):
    return _audited(spark, folder).select(*COLUMNS, "audit_branch", "changed")


def audit_changes(spark, folder):
    return rules.change_counts(_audited(spark, folder))


def cluster_names(spark, folder):
    named = rules.code_label(F.col("label"), rules.CLUSTER_INTENTS)
    return table(spark, folder, "embeddings").select("vec_id", "label", named.alias("intent_label"))


def keyword_reason(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.withColumns(systems.keyword_decision(F.col("text"), KEYWORDS)).drop("text")


def constant_answer(spark, folder):
    docs = table(spark, folder, "documents")
    return systems.constant_answers(docs, "doc_id", "general_inquiry")


def labelling_sheet(spark, folder):
    """Up to 30 rows per cluster, named, with blank answer columns."""
    clustered = given.messages(spark, folder).where(F.col("cluster").isNotNull())
    return labelling.labelling_sheet(clustered).select(
        "conversation_id", "cluster", "intent_label", "is_escalation", "label_notes"
    )


def annotation_sheet(spark, folder):
    """Rows for a second opinion: four per audited intent, topped up to 30."""
    picked = labelling.annotation_sheet(_audited(spark, folder), "conversation_id")
    return picked.select(*COLUMNS, "pick", *labelling.ANNOTATION_DOMAINS)


QUERIES = {
    f.__name__: f
    for f in (
        rule_labels,
        rule_audit,
        audit_changes,
        cluster_names,
        keyword_reason,
        constant_answer,
        labelling_sheet,
        annotation_sheet,
    )
}


def _condition(rule: rules.Rule) -> str:
    parts = ["TRUE"]
    if rule.intents:
        parts.append(f"intent_label IN ({sql.texts(rule.intents)})")
    if rule.patterns:
        parts.append(sql.matches("low", rule.patterns))
    if rule.keywords:
        parts.append(sql.contains_any("low", rule.keywords))
    return " AND ".join(parts)


_RULES = (*PROSE_RULES, *rules.SUPPORT_RULES, rules.SUPPORT_DEFAULT)
_NUMBER = " ".join(f"WHEN {_condition(r)} THEN {i}" for i, r in enumerate(_RULES))
_TABLE = ", ".join(f"({i}, {r.escalate}, {sql.quote(r.note)})" for i, r in enumerate(_RULES))
_LABELLED = f"""
WITH {sql.MESSAGES},
low AS (SELECT *, lower(text) AS low FROM messages),
numbered AS (SELECT *, CASE {_NUMBER} END AS rule FROM low),
rule_table(rule, is_escalation, label_notes) AS (VALUES {_TABLE}),
labelled AS (SELECT * FROM numbered JOIN rule_table USING (rule))
"""

_FINANCE = (
    "'Financial: Monetary charge discrepancy, billing failure, or refund request requiring "
    "account verification.'"
)
# Branch numbers follow the audit: 1 is the prose branch, 2 to 9 the support branches.
_AUDITED = f"""{_LABELLED},
branched AS (
  SELECT *, CASE
    WHEN (contains(low, 'worthless') AND contains(low, 'scum'))
      OR (contains(low, 'trash') AND contains(low, 'idiot')) THEN 1
    WHEN (contains(low, 'randomly plays music') AND contains(low, 'another device'))
      OR contains(low, 'sy mau lapor akun yang kena hack')
      OR contains(low, 'someone logged into my account') OR contains(low, 'compromised')
      OR contains(low, 'stolen') OR contains(low, 'my account has been hacked') THEN 2
    WHEN contains(low, 'charged me 99kr instead of 9') OR contains(low, 'charged twice')
      OR contains(low, 'refund') OR contains(low, 'double charge')
      OR (contains(low, 'payment failure') AND contains(low, 'bank'))
      OR contains(low, 'not able to pay 9 pesos') THEN 3
    WHEN contains(low, 'skip and stutter')
      OR (contains(low, 'why u keep deleting') AND contains(low, 'download'))
      OR contains(low, 'lost control centre integration') OR contains(low, 'app keep crashing')
      OR (contains(low, 'crash') AND contains(low, 'update')) THEN 4
    WHEN contains(low, 'problems with streaming at the moment')
      OR contains(low, 'is {BRAND} down') THEN 5
    WHEN intent_label = 'subscription_issue' THEN 6
    WHEN intent_label = 'feature_request' THEN 7
    WHEN intent_label = 'general_inquiry' THEN 8
    WHEN intent_label = 'off_topic_chatter' THEN 9
    ELSE 0 END::INTEGER AS audit_branch FROM labelled),
tested AS (
  SELECT *,
    intent_label IN ('app_bug', 'feature_request') AS movable,
    {sql.contains_any('low', ('i am not able to sign up', 'how to join'))} AS asks_how,
    {sql.contains_any('low', ('charged', 'refund', 'twice', 'bill', 'smart', 'pesos', 'card', 'pay'))} AS pays,
    {sql.contains_any('low', ('hack', 'login', 'password'))} AS secures
  FROM branched),
written AS (
  SELECT conversation_id, audit_branch, intent_label AS old_intent, is_escalation AS old_flag,
    CASE WHEN audit_branch = 1 AND movable THEN 'off_topic_chatter'
         WHEN audit_branch = 2 THEN 'account_access'
         WHEN audit_branch = 3
          AND intent_label IN ('off_topic_chatter', 'feature_request', 'general_inquiry') THEN 'billing_dispute'
         WHEN audit_branch = 4 AND intent_label = 'feature_request' THEN 'app_bug'
         WHEN audit_branch = 5 THEN 'app_bug'
         WHEN audit_branch = 8 AND secures THEN 'account_access'
         ELSE intent_label END AS intent_label,
    CASE WHEN audit_branch = 1 AND movable THEN TRUE
         WHEN audit_branch = 1 AND contains(low, 'license') THEN FALSE
         WHEN audit_branch IN (2, 3) THEN TRUE
         WHEN audit_branch = 4 AND intent_label = 'feature_request' THEN FALSE
         WHEN audit_branch = 5 THEN FALSE
         WHEN audit_branch = 6 AND asks_how THEN FALSE
         WHEN audit_branch = 6 AND pays THEN TRUE
         WHEN audit_branch = 7 THEN FALSE
         WHEN audit_branch = 8 THEN secures
         WHEN audit_branch = 9 THEN FALSE
         ELSE is_escalation END AS is_escalation,
    CASE WHEN audit_branch = 1 AND movable THEN 'Abuse: moved to chatter.'
         WHEN audit_branch = 1 AND contains(low, 'license') THEN 'Abuse in a license text.'
         WHEN audit_branch = 2 THEN 'Security: Account compromise or suspicious unauthorized device activity requires human intervention.'
         WHEN audit_branch = 3 THEN {_FINANCE}
         WHEN audit_branch = 4 AND intent_label = 'feature_request' THEN 'App Bug: Playback stutter, crash, or local download glitch resolvable via self-serve troubleshooting.'
         WHEN audit_branch = 5 THEN 'Service Status: Inquiring about current streaming availability or temporary service interruption.'
         WHEN audit_branch = 6 AND asks_how THEN 'Subscription FAQ: How-to guidance on signing up or plan features (auto-handled).'
         WHEN audit_branch = 6 AND pays THEN 'Subscription Billing: Account-specific payment issue or family plan billing failure.'
         WHEN audit_branch = 7 THEN 'Feature Request: UI suggestions, wishlist items, or playlist mechanics.'
         WHEN audit_branch = 8 AND secures THEN 'Account Access: Security/sign-in issue.'
         WHEN audit_branch = 8 THEN 'General Inquiry: Public information, catalog, or channel availability.'
         WHEN audit_branch = 9 THEN 'Off-Topic: Casual social interaction, memes, or artist praise.'
         ELSE label_notes END AS label_notes
  FROM tested),
audited AS (
  SELECT conversation_id, intent_label, is_escalation, label_notes, audit_branch,
         intent_label <> old_intent OR is_escalation <> old_flag AS changed
  FROM written)
"""

_HITS = sql.hits("low", KEYWORDS)

ORACLE = {
    "rule_labels": f"{_LABELLED} SELECT conversation_id, intent_label, is_escalation, label_notes FROM labelled",
    "rule_audit": f"{_AUDITED} SELECT * FROM audited",
    "audit_changes": f"{_AUDITED} SELECT audit_branch, count(*) AS rows_taken, "
    "count(*) FILTER (WHERE changed) AS rows_changed FROM audited GROUP BY audit_branch",
    "labelling_sheet": f"""WITH {sql.MESSAGES}
SELECT conversation_id, cluster, intent_label, '' AS is_escalation, '' AS label_notes FROM messages
WHERE cluster IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY cluster
                           ORDER BY md5(conversation_id::VARCHAR || ':42'), conversation_id) <= 30""",
    "annotation_sheet": f"""{_AUDITED},
r AS (
  SELECT *, row_number() OVER (PARTITION BY intent_label ORDER BY conversation_id) AS rn,
         min(conversation_id) OVER (PARTITION BY intent_label) AS seen FROM audited),
o AS (
  SELECT *, row_number() OVER (
    ORDER BY rn > 4, CASE WHEN rn > 4 THEN conversation_id ELSE seen END, conversation_id) AS pick
  FROM r)
SELECT conversation_id, intent_label, is_escalation, label_notes, pick::INTEGER AS pick,
       '' AS human_expected_escalation, '' AS human_target_accuracy, '' AS human_target_tone
FROM o WHERE pick <= 30""",
    "cluster_names": f"SELECT vec_id, label, {sql.intent('label')} AS intent_label FROM embeddings",
    "keyword_reason": f"""
WITH d AS (SELECT doc_id, lower(text) AS low FROM documents),
h AS (SELECT doc_id, {_HITS} AS found FROM d)
SELECT doc_id, found <> '' AS is_escalation,
       CASE WHEN found <> '' THEN 'Keyword heuristic triggered by terms: ' || found
            ELSE 'No escalation keywords detected; auto-handled.' END AS escalation_reason
FROM h""",
    "constant_answer": f"""
SELECT doc_id, 'constant' AS system, 'general_inquiry' AS predicted_intent, 1.0::DOUBLE AS confidence,
       FALSE AS is_escalation, 'Trivial rule: never escalate any tickets.' AS escalation_reason,
       {sql.quote(systems.TEMPLATE_REPLY)} AS draft_reply FROM documents""",
}
