"""One message, or a table of them, through classifier, retrieval and a user's model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley import schemas
from parley.operators import enrich, retrieval
from parley.operators.classify import Classifier


def triage_prompts(
    messages: DataFrame,
    corpus: DataFrame,
    classifier: Classifier,
    key: str = "conversation_id",
    text: str = "first_customer_text_clean",
    vec: str = "embedding",
    k: int = 3,
    exclude_self: bool = True,
) -> DataFrame:
    """Messages with intent, confidence, past cases and the prompt built from them.

    Every message has a row. One without a usable vector has no intent, no confidence and no
    cases, and its prompt says so.
    """
    found = retrieval.hits(corpus, messages, key, vec, k, exclude_self)
    classified = classifier.predict(messages, vec)
    rows = retrieval.with_context(classified, found, key)
    return rows.withColumn(
        "prompt",
        retrieval.prompt(
            F.coalesce(text, F.lit("")),
            F.coalesce("intent", F.lit("unknown")),
            F.coalesce("confidence", F.lit(0.0)),
            F.col("context"),
        ),
    )


def triage(
    prompts: DataFrame,
    cache: str,
    call: Callable[[dict], str],
    key: str = "conversation_id",
    failed: str = "ANSWER_FAILED",
) -> DataFrame:
    """Decisions for prompted messages; ``call`` turns a prompt into JSON text.

    Only messages without a cached answer are sent.
    """
    requests = prompts.select(F.col(key).cast("string").alias("key"), "prompt")
    raw = enrich.answers(requests, cache, call, schema=schemas.AGENT_DECISION)
    parsed = enrich.with_parsed(raw, "raw", schemas.AGENT_DECISION, failed).drop("raw", "error")
    return (
        prompts.withColumnsRenamed({"intent": "classifier_intent", "confidence": "classifier_confidence"})
        .drop("prompt", "context")
        .join(parsed, F.col(key).cast("string") == F.col("key"))
        .drop("key")
    )
