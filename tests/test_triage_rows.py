"""Every message has a row in triage, with a vector or without."""

import math

from pyspark.sql import functions as F

from parley.catalog import models
from parley.operators import classify, retrieval
from parley.plans import triage
from parley.sources.given import table

FOLDER = "/root/testdata/sf0.01"


def test_prompts_for_every_document(spark):
    docs, known = (table(spark, FOLDER, name).count() for name in ("documents", "embeddings"))
    got = models.triage_prompts(spark, FOLDER)
    row = got.agg(
        F.count("*").alias("n"), F.countDistinct("conversation_id").alias("ids"),
        F.count("intent").alias("intents"), F.count("confidence").alias("sure"), F.count("prompt").alias("prompts"),
    ).first()
    assert tuple(row) == (docs, docs, known, known, docs) and known < docs
    bare = got.where("intent is null")
    assert bare.where(~F.contains("prompt", F.lit(retrieval.NO_CONTEXT))).count() == 0


def test_stream_of_every_document(spark):
    got = models.stream_all_messages(spark, FOLDER)
    assert got.count() == table(spark, FOLDER, "documents").count()
    assert got.where("told is null or not told").count() == 0


def test_unusable_vectors_keep_their_rows(spark):
    rows = [
        (1, "a", "x", [1.0, 0.0]), (2, "b", "y", [0.0, 1.0]), (3, "c", "x", None),
        (4, "d", "x", [math.nan, 1.0]), (5, None, "x", [None, 1.0]), (None, "e", "x", None),
    ]
    frame = spark.createDataFrame(
        [(*r, "reply", 0, True) for r in rows],
        "conversation_id long, first_customer_text_clean string, intent_label string, embedding array<float>, "
        "last_brand_reply_clean string, cluster int, is_resolved boolean",
    )
    model = classify.fit_classifier(frame.where("conversation_id < 3"), "intent_label")
    got = {r.conversation_id: r for r in triage.triage_prompts(frame, frame, model).collect()}
    assert len(got) == len(rows)
    assert [got[i].intent for i in (1, 2, 3, 4, 5, None)] == ["x", "y", None, None, None, None]
    assert all(r.prompt.startswith("A customer wrote:\n" + (r.first_customer_text_clean or "")) for r in got.values())
    assert got[3].context == retrieval.NO_CONTEXT and "unknown (confidence 0.00)" in got[3].prompt
