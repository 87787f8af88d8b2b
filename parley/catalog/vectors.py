"""Registered queries on vectors: similarity, clusters, retrieval, prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.catalog import sql
from parley.functions import text as tx
from parley.functions import vectors as vx
from parley.operators import classify, clusters, retrieval, similarity
from parley.session import shared_dir, stage
from parley.sources import given
from parley.sources.given import table
from parley.streaming import triage


def _vectors(spark, folder):
    return table(spark, folder, "embeddings")


def unit_vectors(spark, folder):
    unit = F.posexplode(vx.unit(F.col("embedding"))).alias("pos", "value")
    return _vectors(spark, folder).select("vec_id", unit).withColumn("value", F.round("value", 6))


def cosine_topk(spark, folder):
    points = similarity.dense(_vectors(spark, folder), "vec_id", "embedding")
    return similarity.topk(points, points, 3, exclude_self=True)


def cell_topk(spark, folder):
    points = similarity.dense(_vectors(spark, folder), "vec_id", "embedding")
    return similarity.cell_topk(points, points, 3, exclude_self=True)


SHIFT = 1_000_000


def _doubled(spark, folder):
    """Every vector twice, the copy under a number of its own."""
    own = _vectors(spark, folder).select("vec_id", "embedding")
    copy = own.withColumn("vec_id", F.col("vec_id") + SHIFT)
    return similarity.dense(own.unionByName(copy), "vec_id", "embedding")


def copies_topk(spark, folder):
    """The search for any number of queries, on a table where every row has a copy."""
    points = _doubled(spark, folder)
    return similarity.distinct_topk(points, points, 3, exclude_self=True)


def unusable_vectors(spark, folder):
    """Documents without a vector, and what is wrong with the vectors of others."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"))
    rows = docs.join(_vectors(spark, folder).select("vec_id", "embedding"), "vec_id", "left")
    return similarity.unusable(rows, "vec_id", "embedding", 64)


def centroids(spark, folder):
    found = clusters.centroids(_vectors(spark, folder), "label")
    return found.select("label", "n", F.posexplode("centroid").alias("pos", "value")).withColumn(
        "value", F.round("value", 6)
    )


def inertia(spark, folder):
    return clusters.inertia(_vectors(spark, folder), "label")


def representatives(spark, folder):
    return clusters.representatives(_vectors(spark, folder), "vec_id", "label")


def silhouette_exact(spark, folder):
    return clusters.silhouette(_vectors(spark, folder), "vec_id", "embedding", ["label"])


def silhouette_estimate(spark, folder):
    """The estimate on at most 1,000 rows per label, which sample every label of these tables whole."""
    found = clusters.silhouette_estimate(_vectors(spark, folder), "vec_id", "embedding", "label")
    return found.select("labeling", "n", "silhouette", (F.col("low") == F.col("high")).alias("no_margin"))


def class_weights(spark, folder):
    found = classify.class_weights(_vectors(spark, folder), "label")
    return found.withColumn("weight", F.round("weight", 6))


def cases(spark, folder):
    """All messages, with the last reply of the conversation of that id.

    A message without a vector stays; it is nobody's neighbour and has none.
    """
    turns = table(spark, folder, "conversations").where(F.col("role") == "assistant")
    replies = turns.groupBy(F.col("conv_id").alias("conversation_id")).agg(
        tx.clean_text(F.max_by("text", "turn")).alias("last_brand_reply_clean")
    )
    known = replies.select("conversation_id", F.lit(True).alias("is_resolved"))
    vectors = given.vectors(spark, folder).select("conversation_id", "embedding")
    messages = given.messages(spark, folder).join(vectors, "conversation_id", "left")
    corpus = retrieval.build_corpus(messages, replies)
    return corpus.join(known, "conversation_id", "left")


def _hits(spark, folder):
    corpus = cases(spark, folder)
    return retrieval.hits(corpus, corpus.select("conversation_id", "embedding"))


def reply_corpus(spark, folder):
    return cases(spark, folder).select("conversation_id", "last_brand_reply_clean")


def retrieved_cases(spark, folder):
    return _hits(spark, folder)


def topk_context(spark, folder):
    queries = cases(spark, folder).select("conversation_id")
    found = retrieval.with_context(queries, _hits(spark, folder))
    return found.select("conversation_id", "context")


def prompt_text(spark, folder):
    known = cases(spark, folder).select(
        "conversation_id", "first_customer_text_clean", "intent_label"
    )
    hits = stage(_hits(spark, folder))
    best = hits.where("rank = 1").select(F.col("query_id").alias("conversation_id"), "similarity")
    rows = retrieval.with_context(known.join(best, "conversation_id", "left"), hits)
    return rows.select(
        "conversation_id",
        retrieval.prompt(
            F.col("first_customer_text_clean"),
            F.col("intent_label"),
            F.coalesce("similarity", F.lit(0.0)),
            F.col("context"),
        ).alias("prompt"),
    )


def stream_retrieval(spark, folder):
    """Vectors read as a file stream; each micro-batch looks up its nearest stored vectors."""
    stored = _vectors(spark, folder)
    corpus = similarity.dense(stored, "vec_id", "embedding")
    stream = triage.read_table(spark, f"{folder}/embeddings.parquet", stored.schema)

    def look_up(batch):
        queries = similarity.dense(batch, "vec_id", "embedding")
        return similarity.topk(corpus, queries, 3, exclude_self=True)

    place = f"{shared_dir(spark)}/stream_retrieval_{uuid.uuid4().hex}"
    triage.write_batches(stream, f"{place}/out", f"{place}/state", look_up).awaitTermination()
    return spark.read.parquet(f"{place}/out").drop("batch")


QUERIES = {
    f.__name__: f
    for f in (
        stream_retrieval,
        unit_vectors,
        cosine_topk,
        cell_topk,
        copies_topk,
        unusable_vectors,
        centroids,
        inertia,
        representatives,
        silhouette_exact,
        silhouette_estimate,
        class_weights,
        reply_corpus,
        retrieved_cases,
        topk_context,
        prompt_text,
    )
}

_CENTERS = f"""WITH {sql.UNIT},
parts AS (SELECT vec_id, label, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS pos FROM unit),
centers AS (SELECT label, pos, avg(x) AS c, count(*) AS n FROM parts GROUP BY label, pos)
"""
_TOPK = f"WITH {sql.cosine('SELECT * FROM unit')} SELECT query_id, id, similarity, rank::INTEGER AS rank FROM near"
_KNOWN = "SELECT * FROM unit WHERE vec_id IN (SELECT doc_id FROM documents)"
_HITS = f"""WITH {sql.cosine(_KNOWN)}, {sql.MESSAGES}, {sql.CASES},
hits AS (
  SELECT n.query_id, n.rank::INTEGER AS rank, n.similarity, n.id AS conversation_id,
         c.text AS customer_text, c.brand_reply, c.intent_label, c.cluster, c.is_resolved
  FROM near n JOIN cases c ON c.conversation_id = n.id),
contexts AS (
  SELECT query_id,
         string_agg('Case ' || rank || ' (' || intent_label || ', similarity '
                    || {sql.two_places('similarity')} || ')' || chr(10)
                    || 'Asked: ' || customer_text || chr(10) || 'Answered: ' || brand_reply,
                    chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits GROUP BY query_id)
"""

ORACLE = {
    "unit_vectors": f"""WITH {sql.UNIT}
SELECT vec_id, (generate_subscripts(u, 1) - 1)::INTEGER AS pos, round(unnest(u), 6) AS value FROM unit""",
    "cosine_topk": _TOPK,
    "cell_topk": _TOPK,
    "stream_retrieval": _TOPK,
    "copies_topk": _TOPK.replace(
        "SELECT * FROM unit",
        f"SELECT vec_id, u FROM unit UNION ALL SELECT vec_id + {SHIFT}, u FROM unit",
    ),
    "unusable_vectors": "SELECT doc_id AS id, CASE WHEN vec_id IS NULL THEN 'missing' ELSE 'length' END "
    "AS reason FROM documents LEFT JOIN embeddings ON vec_id = doc_id "
    "WHERE vec_id IS NULL OR len(embedding) <> 64",
    "centroids": f"{_CENTERS} SELECT label, n, pos::INTEGER AS pos, round(c, 6) AS value FROM centers",
    "inertia": f"""{_CENTERS}
SELECT count(DISTINCT label) AS labels, (SELECT count(*) FROM unit) AS n,
       round(sum((x - c) * (x - c)), 6) AS inertia
FROM parts JOIN centers USING (label, pos)""",
    "representatives": f"""{_CENTERS},
scored AS (
  SELECT label, vec_id, round(sum(x * c), 6) AS score
  FROM parts JOIN centers USING (label, pos) GROUP BY label, vec_id)
SELECT label, vec_id, score,
       row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INTEGER AS rank
FROM scored QUALIFY rank <= 3""",
    "silhouette_exact": f"""WITH {sql.UNIT},
gaps AS (
  SELECT a.vec_id, a.label AS own, b.label,
         list_distance(a.u, b.u) AS d, a.vec_id = b.vec_id AS same
  FROM unit a JOIN unit b ON TRUE),
per_label AS (
  SELECT vec_id, own, label, sum(d) AS total, count(*) AS n FROM gaps WHERE NOT same GROUP BY ALL),
per_row AS (
  SELECT vec_id, max(CASE WHEN label = own THEN total / n END) AS a,
         min(CASE WHEN label <> own THEN total / n END) AS b
  FROM per_label GROUP BY vec_id)
SELECT 'label' AS labeling, count(*) AS n,
       round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM per_row""",
    "class_weights": """
SELECT label, count(*) AS n,
       round((SELECT count(*) FROM embeddings)::DOUBLE
             / ((SELECT count(DISTINCT label) FROM embeddings) * count(*)), 6) AS weight
FROM embeddings GROUP BY label""",
    "reply_corpus": f"WITH {sql.MESSAGES}, {sql.CASES} "
    "SELECT conversation_id, brand_reply AS last_brand_reply_clean FROM cases",
    "retrieved_cases": f"{_HITS} SELECT * FROM hits",
    "topk_context": f"""{_HITS}
SELECT e.conversation_id, coalesce(context, 'No historical resolutions found.') AS context
FROM cases e LEFT JOIN contexts c ON c.query_id = e.conversation_id""",
    "prompt_text": f"""{_HITS}
SELECT c.conversation_id,
       'A customer wrote:' || chr(10) || c.text || chr(10) || chr(10) || 'Likely intent: '
       || c.intent_label || ' (confidence ' || {sql.two_places('coalesce(h.similarity, 0)')} || ')'
       || chr(10) || chr(10) || coalesce(x.context, 'No historical resolutions found.')
       || chr(10) || chr(10)
       || 'Return JSON with reasoning, predicted_intent, is_escalation, '
       || 'escalation_reason and draft_reply.' AS prompt
FROM cases c LEFT JOIN hits h ON h.query_id = c.conversation_id AND h.rank = 1
     LEFT JOIN contexts x ON x.query_id = c.conversation_id""",
}
ORACLE["silhouette_estimate"] = f"SELECT *, true AS no_margin FROM ({ORACLE['silhouette_exact']})"
