"""Ordered rules as data, compiled to ``CASE`` expressions.

A rule table is a list; the first rule that matches decides. The tables below are
defaults: callers pass their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as tx


def code_label(code: Column, names: Mapping[int, str], default: str = "unknown") -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[code], F.lit(default))


def first_match(cases: Sequence[tuple[Column, Column | int]], otherwise: int) -> Column:
    """Value of the first case that holds, as one flat ``CASE``."""
    if not cases:
        return F.lit(otherwise)
    (test, value), *rest = cases
    chain = F.when(test, value)
    for test, value in rest:
        chain = chain.when(test, value)
    return chain.otherwise(otherwise)


@dataclass(frozen=True)
class Rule:
    """Matches when every part that is given matches."""

    escalate: bool
    note: str
    patterns: Sequence[str] = ()
    keywords: Sequence[str] = ()
    intents: Sequence[str] = ()

    def condition(self, lowered: Column, intent: Column, any_pattern: Column) -> Column:
        test = F.lit(True)
        if self.intents:
            test = test & intent.isin(*self.intents)
        if self.patterns:
            test = test & any_pattern & tx.matches_any(lowered, self.patterns)
        if self.keywords:
            test = test & tx.contains_any(lowered, self.keywords)
        return F.coalesce(test, F.lit(False))


def apply_rules(
    df: DataFrame,
    rules: Sequence[Rule],
    default: Rule,
    text: str = "first_customer_text_clean",
    intent: str = "intent_label",
    normalize_quotes: bool = False,
) -> DataFrame:
    """Add ``is_escalation`` and ``label_notes``."""
    raw = F.coalesce(F.col(text), F.lit(""))
    # Lowered once, as a column: each condition would otherwise lower the text again. One
    # pass over all patterns spares most texts a pass per rule. The chain yields a rule
    # number, so each condition appears once in the plan.
    patterns = [p for rule in rules for p in rule.patterns]
    df = df.withColumn("_low", F.lower(tx.straighten_quotes(raw) if normalize_quotes else raw))
    df = df.withColumn("_any", tx.matches_any(F.col("_low"), patterns) if patterns else F.lit(False))
    lowered = F.col("_low")
    wanted = F.lower(F.coalesce(F.col(intent), F.lit("")))
    number = first_match([(r.condition(lowered, wanted, F.col("_any")), i) for i, r in enumerate(rules)], len(rules))
    outcomes = [*rules, default]
    flags = F.array(*[F.lit(r.escalate) for r in outcomes])
    notes = F.array(*[F.lit(r.note) for r in outcomes])
    return (
        df.withColumn("_rule", number)
        .withColumns(
            {
                "is_escalation": flags[F.col("_rule")],
                "label_notes": notes[F.col("_rule")],
            }
        )
        .drop("_rule", "_low", "_any")
    )


@dataclass(frozen=True)
class Outcome:
    """What an audit branch writes; a part left ``None`` keeps the old value."""

    escalate: bool | None = None
    note: str | None = None
    intent: str | None = None
    if_intents: Sequence[str] = ()
    if_keywords: Sequence[str] = ()


@dataclass(frozen=True)
class Branch:
    """Matches on any phrase set (all phrases of one set) or on the old intent.

    A matching branch takes the row even when none of its outcomes applies.
    """

    outcomes: Sequence[Outcome]
    phrases: Sequence[Sequence[str]] = ()
    intents: Sequence[str] = ()

    def condition(self, lowered: Column, intent: Column) -> Column:
        test = F.lit(False)
        for phrase_set in self.phrases:
            every = F.lit(True)
            for phrase in phrase_set:
                every = every & F.contains(lowered, F.lit(phrase))
            test = test | every
        if self.intents:
            test = test | F.coalesce(intent.isin(*self.intents), F.lit(False))
        return test


def audit(
    df: DataFrame,
    branches: Sequence[Branch],
    text: str = "first_customer_text_clean",
    intent: str = "intent_label",
    flag: str = "is_escalation",
    note: str = "label_notes",
) -> DataFrame:
    """Rewrite intent, flag and note together; adds ``audit_branch`` and ``changed``.

    ``audit_branch`` is the 1-based branch that took the row, 0 for none.
    """
    df = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    lowered = F.col("_low")
    old_intent = F.col(intent)
    flat: list[tuple[int, Outcome | None]] = [(0, None)]
    chain = []
    for number, branch in enumerate(branches, 1):
        inner = []
        for outcome in branch.outcomes:
            test = F.lit(True)
            if outcome.if_intents:
                test = test & old_intent.isin(*outcome.if_intents)
            if outcome.if_keywords:
                test = test & tx.contains_any(lowered, outcome.if_keywords)
            inner.append((F.coalesce(test, F.lit(False)), len(flat)))
            flat.append((number, outcome))
        nothing = len(flat)
        flat.append((number, None))
        chain.append((branch.condition(lowered, old_intent), first_match(inner, nothing)))
    case_number = first_match(chain, 0)

    def written(value, old: Column, kind: str) -> Column:
        options = F.array(
            *[
                F.lit(None if o is None else value(o)).cast(kind)
                for _, o in flat
            ]
        )
        return F.coalesce(options[F.col("_case")], old)

    new = {
        "_intent": written(lambda o: o.intent, old_intent, "string"),
        "_flag": written(lambda o: o.escalate, F.col(flag), "boolean"),
        "_note": written(lambda o: o.note, F.col(note), "string"),
        "audit_branch": F.array(*[F.lit(n) for n, _ in flat])[F.col("_case")],
    }
    return (
        df.withColumn("_case", case_number)
        .withColumns(new)
        .withColumn(
            "changed",
            ~F.col("_intent").eqNullSafe(old_intent) | ~F.col("_flag").eqNullSafe(F.col(flag)),
        )
        .withColumns({intent: F.col("_intent"), flag: F.col("_flag"), note: F.col("_note")})
        .drop("_low", "_case", "_intent", "_flag", "_note")
    )


def change_counts(audited: DataFrame) -> DataFrame:
    """Rows taken and rows changed per audit branch."""
    return audited.groupBy("audit_branch").agg(
        F.count("*").alias("rows_taken"), F.count_if("changed").alias("rows_changed")
    )


# ---------------------------------------------------------------------------
# Cluster names, keyword lists, patterns, phrases and notes.
# ---------------------------------------------------------------------------

CLUSTER_INTENTS = {
    0: "subscription_issue",
    1: "account_access",
    2: "general_inquiry",
    3: "off_topic_chatter",
    4: "app_bug",
    5: "billing_dispute",
    6: "feature_request",
}

INTENTS = tuple(CLUSTER_INTENTS.values())

ESCALATION_KEYWORDS = (
    "hack", "hacked", "stolen", "compromised", "unauthorized", "charge", "charged",
    "refund", "double bill", "billed twice", "fraud", "banned", "password reset",
    "cant login", "can't login", "cannot log in", "cant sign in", "can't sign in",
    "cannot sign in",
)

SECURITY_PATTERNS = (
    r"\bhack(ed)?\b",
    r"\bcompromis(ed)?\b",
    r"\bstolen\b",
    r"\bchanged my (email|password)\b",
    r"\bwithout my (permission|consent)\b",
    r"\bunauthorized\b",
    r"\bsuspicious\b",
)

LOCKOUT_PATTERNS = (
    r"\bcant (log|sign) in\b",
    r"\bcan't (log|sign) in\b",
    r"\bcannot (log|sign) in\b",
    r"\bunable to (log|sign) in\b",
    r"\bdeleted my (facebook|fb)\b",
    r"\bno longer have access\b",
    r"\bpassword reset\b",
    r"\blocked out\b",
    r"\bcheck your dms?\b",
    r"\bsent (you )?a dm\b",
)

BILLING_PATTERNS = (
    r"\bcharged twice\b",
    r"\bcharged 2 times\b",
    r"\bdouble charge\b",
    r"\brefund\b",
    r"\bdispute\b",
    r"\bwrong (amount|charge)\b",
    r"\bpayment (failed|problem|issue)\b",
    r"\bnot able to pay\b",
    r"\bcancel (my )?(premium|subscription)\b",
    r"\bcharged but\b",
    r"\bcharged .* not free\b",
    r"\bcharged multiple\b",
)

SUPPORT_RULES = (
    Rule(
        True,
        "Security/Hijack: Account compromise requires human verification.",
        patterns=SECURITY_PATTERNS,
    ),
    Rule(
        True,
        "Account Access: User cannot access account / needs DM identity verification.",
        patterns=LOCKOUT_PATTERNS,
    ),
    Rule(
        True,
        "Billing Dispute: Monetary transactions and refund requests require human review.",
        patterns=BILLING_PATTERNS,
    ),
    Rule(
        True,
        "Billing Dispute: Financial issue requiring human account inspection.",
        intents=("billing_dispute",),
    ),
    Rule(
        False,
        "General question about account settings (self-serve).",
        intents=("account_access",),
        keywords=("how do i", "is it possible", "how to"),
    ),
    Rule(
        True,
        "Account Access: Sign-in or credential roadblock requiring backstage check.",
        intents=("account_access",),
    ),
    Rule(
        False,
        "Feature Request: Feedback or enhancement suggestion (auto-handled).",
        intents=("feature_request",),
    ),
    Rule(
        False,
        "Off-topic banter or social engagement (auto-handled).",
        intents=("off_topic_chatter",),
    ),
    Rule(
        False,
        "General Inquiry: FAQ or product question resolvable via standard info.",
        intents=("general_inquiry",),
    ),
    Rule(
        False,
        "Technical Bug: Resolvable via standard self-serve troubleshooting (cache/reinstall).",
        intents=("app_bug",),
    ),
    Rule(
        True,
        "Subscription/Payment: Plan setup or billing issue requiring human check.",
        intents=("subscription_issue",),
        keywords=("pay", "card", "bill", "charge", "promo", "code", "family", "plan"),
    ),
    Rule(
        False,
        "Subscription information resolvable via FAQ.",
        intents=("subscription_issue",),
    ),
)

SUPPORT_DEFAULT = Rule(False, "Default: Standard customer inquiry.")


def support_audit(brand: str) -> tuple[Branch, ...]:
    """Audit branches for a support corpus; the brand's name is part of one phrase."""
    financial = (
        "Financial: Monetary charge discrepancy, billing failure, or refund request "
        "requiring account verification."
    )
    return (
        Branch(
            phrases=(
                ("randomly plays music", "another device"),
                ("sy mau lapor akun yang kena hack",),
                ("someone logged into my account",),
                ("compromised",),
                ("stolen",),
                ("my account has been hacked",),
            ),
            outcomes=(
                Outcome(
                    intent="account_access",
                    escalate=True,
                    note="Security: Account compromise or suspicious unauthorized device "
                    "activity requires human intervention.",
                ),
            ),
        ),
        Branch(
            phrases=(
                ("charged me 99kr instead of 9",),
                ("charged twice",),
                ("refund",),
                ("double charge",),
                ("payment failure", "bank"),
                ("not able to pay 9 pesos",),
            ),
            outcomes=(
                Outcome(
                    if_intents=("off_topic_chatter", "feature_request", "general_inquiry"),
                    intent="billing_dispute",
                    escalate=True,
                    note=financial,
                ),
                Outcome(escalate=True, note=financial),
            ),
        ),
        Branch(
            phrases=(
                ("skip and stutter",),
                ("why u keep deleting", "download"),
                ("lost control centre integration",),
                ("app keep crashing",),
                ("crash", "update"),
            ),
            outcomes=(
                Outcome(
                    if_intents=("feature_request",),
                    intent="app_bug",
                    escalate=False,
                    note="App Bug: Playback stutter, crash, or local download glitch "
                    "resolvable via self-serve troubleshooting.",
                ),
            ),
        ),
        Branch(
            phrases=(
                ("problems with streaming at the moment",),
                (f"is {brand} down",),
            ),
            outcomes=(
                Outcome(
                    intent="app_bug",
                    escalate=False,
                    note="Service Status: Inquiring about current streaming availability "
                    "or temporary service interruption.",
                ),
            ),
        ),
        Branch(
            intents=("subscription_issue",),
            outcomes=(
                Outcome(
                    if_keywords=("i am not able to sign up", "how to join"),
                    escalate=False,
                    note="Subscription FAQ: How-to guidance on signing up or plan features "
                    "(auto-handled).",
                ),
                Outcome(
                    if_keywords=(
                        "charged", "refund", "twice", "bill", "smart", "pesos", "card", "pay",
                    ),
                    escalate=True,
                    note="Subscription Billing: Account-specific payment issue or family plan "
                    "billing failure.",
                ),
            ),
        ),
        Branch(
            intents=("feature_request",),
            outcomes=(
                Outcome(
                    escalate=False,
                    note="Feature Request: UI suggestions, wishlist items, or playlist mechanics.",
                ),
            ),
        ),
        Branch(
            intents=("general_inquiry",),
            outcomes=(
                Outcome(
                    if_keywords=("hack", "login", "password"),
                    intent="account_access",
                    escalate=True,
                    note="Account Access: Security/sign-in issue.",
                ),
                Outcome(
                    escalate=False,
                    note="General Inquiry: Public information, catalog, or channel availability.",
                ),
            ),
        ),
        Branch(
            intents=("off_topic_chatter",),
            outcomes=(
                Outcome(
                    escalate=False,
                    note="Off-Topic: Casual social interaction, memes, or artist praise.",
                ),
            ),
        ),
    )
