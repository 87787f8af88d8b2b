"""Fixed schemas; no job infers one."""

from pyspark.sql import types as T

STR, LONG, INT, DBL, BOOL = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


TWEETS = _struct(
    ("tweet_id", STR),
    ("author_id", STR),
    ("inbound", BOOL),
    ("created_at", STR),
    ("text", STR),
    ("response_tweet_id", STR),
    ("in_response_to_tweet_id", STR),
)

THREADS = _struct(
    ("conversation_id", STR),
    ("num_turns", INT),
    ("first_customer_text", STR),
    ("last_brand_reply", STR),
    ("conversation_text", STR),
    ("is_resolved", BOOL),
    ("created_at", STR),
    ("first_customer_text_clean", STR),
    ("last_brand_reply_clean", STR),
    ("customer_word_count", INT),
)

CUSTOMER_MESSAGES = _struct(
    ("conversation_id", STR),
    ("first_customer_text_clean", STR),
    ("num_turns", INT),
    ("is_resolved", BOOL),
    ("customer_word_count", INT),
)

CLUSTERED_MESSAGES = T.StructType(
    CUSTOMER_MESSAGES.fields + _struct(("cluster", INT), ("intent_label", STR)).fields
)

EMBEDDINGS = _struct(("conversation_id", STR), ("embedding", T.ArrayType(T.FloatType())))

GOLDEN_SET = _struct(
    ("conversation_id", STR),
    ("cluster", INT),
    ("intent_label", STR),
    ("first_customer_text_clean", STR),
    ("num_turns", INT),
    ("is_resolved", BOOL),
    ("is_escalation", STR),
    ("label_notes", STR),
)

HUMAN_BENCHMARK = T.StructType(
    GOLDEN_SET.fields
    + _struct(
        ("human_expected_escalation", STR),
        ("human_target_accuracy", STR),
        ("human_target_tone", STR),
        ("human_qa_notes", STR),
    ).fields
)

AGENT_DECISION = _struct(
    ("reasoning", STR),
    ("predicted_intent", STR),
    ("is_escalation", BOOL),
    ("escalation_reason", STR),
    ("draft_reply", STR),
)

JUDGE_GRADES = _struct(
    ("reasoning", STR),
    ("rag_accuracy", STR),
    ("rag_tone", STR),
    ("rag_escalation", STR),
    ("simp_accuracy", STR),
    ("simp_tone", STR),
    ("simp_escalation", STR),
)

RETRIEVED_HIT = _struct(
    ("rank", INT),
    ("similarity", DBL),
    ("conversation_id", STR),
    ("customer_text", STR),
    ("brand_reply", STR),
    ("intent_label", STR),
    ("cluster", INT),
    ("is_resolved", BOOL),
)
