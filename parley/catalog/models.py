"""Registered queries on fitted models, whose numbers depend on a solver and have no SQL."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from parley.catalog import sql, vectors
from parley.functions import vectors as vx
from parley.operators import classify, clusters
from parley.plans import triage
from parley.session import shared_dir, stage
from parley.sources.given import table
from parley.streaming import triage as messages


def _vectors(spark, folder):
    return table(spark, folder, "embeddings")


def kmeans_assign(spark, folder):
    return clusters.cluster(_vectors(spark, folder), n_init=10).select("vec_id", "cluster")


def k_sweep(spark, folder):
    return clusters.sweep(_vectors(spark, folder), "vec_id")


def k_sweep_facts(spark, folder):
    """What holds for the best fit of every k: all rows placed, no cell empty, cost about the means."""
    points = clusters.features(_vectors(spark, folder)).select("vec_id", "embedding", "features")
    points = points.persist()
    rows = []
    for k, model in clusters.fit_many(points, range(3, 8), n_init=3).items():
        placed = clusters.assign(points, model)
        sizes = placed.groupBy("cluster").count().agg(F.sum("count").alias("n"), F.count("*").alias("cells")).first()
        cost = clusters.inertia(placed, "cluster").first()["inertia"]
        rows.append((k, sizes["n"], sizes["cells"], abs(cost - model.cost) < 1e-3 * model.cost))
    points.unpersist()
    return spark.createDataFrame(rows, "k bigint, n bigint, cells bigint, cost_agrees boolean")


def silhouette_squared(spark, folder):
    found = clusters.squared_silhouette(_vectors(spark, folder), "label")
    return found.select(F.round("squared_silhouette", 6).alias("squared_silhouette"))


def pca_2d(spark, folder):
    return clusters.project_2d(_vectors(spark, folder), "vec_id")


def classify_intents(spark, folder):
    rows = _vectors(spark, folder)
    model = classify.fit_classifier(rows, "label")
    return model.predict(rows).select("vec_id", "label", "intent", "confidence")


def triage_prompts(spark, folder):
    """All messages, classified, with their past cases and the prompt for a user's model.

    The classifier learns from messages with a vector; the others have no intent and no cases.
    """
    cases = vectors.cases(spark, folder)
    model = classify.fit_classifier(cases.where("embedding is not null"), "intent_label")
    rows = triage.triage_prompts(cases, cases, model)
    return rows.select("conversation_id", "intent", "confidence", "prompt")


def _streamed(spark, folder, name, key):
    """The whole flow on a stream: classifier and case index are built once, batches use both."""
    corpus = stage(vectors.cases(spark, folder))
    model = classify.fit_classifier(corpus.where("embedding is not null"), "intent_label")
    schema = table(spark, folder, name).schema
    stream = messages.read_table(spark, f"{folder}/{name}.parquet", schema)

    def answer(batch):
        own = batch.select(F.col(key).alias("conversation_id"))
        found = triage.triage_prompts(
            corpus.join(own, "conversation_id", "left_semi"), corpus, model
        )
        intent = F.coalesce("intent", F.lit("unknown"))
        told = F.contains("prompt", intent) & F.contains("prompt", F.col("context"))
        return found.select("conversation_id", "context", told.alias("told"))

    place = f"{shared_dir(spark)}/stream_messages_{uuid.uuid4().hex}"
    messages.write_batches(stream, f"{place}/out", f"{place}/state", answer).awaitTermination()
    return spark.read.parquet(f"{place}/out").drop("batch")


def stream_messages(spark, folder):
    """The flow on the stream of vectors: messages that come with one."""
    return _streamed(spark, folder, "embeddings", "vec_id")


def stream_all_messages(spark, folder):
    """The flow on the stream of documents: every message, with a vector or without."""
    return _streamed(spark, folder, "documents", "doc_id")


def kmeans_facts(spark, folder):
    """What holds for any k-means result: rows lie at their nearest centre, costs add up."""
    points = clusters.features(_vectors(spark, folder)).select("vec_id", "features")
    model = clusters.fit_kmeans(points, n_init=2)
    centers = [F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()]
    gaps = F.array(
        *[
            F.aggregate(
                F.zip_with(vector_to_array("features"), center, lambda x, y: F.pow(x - y, 2)),
                F.lit(0.0),
                lambda total, x: total + x,
            )
            for center in centers
        ]
    )
    rows = clusters.assign(points, model).select("cluster", gaps.alias("gaps"))
    own = F.col("gaps")[F.col("cluster")]
    cost = float(model.summary.trainingCost)
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(own > F.array_min("gaps") + 1e-9).alias("misplaced"),
        (F.abs(F.sum(own) - cost) < 1e-6 * cost).alias("costs_agree"),
    )


def pca_facts(spark, folder):
    """What holds for any two principal components: centred, uncorrelated, of the stated share."""
    found = pca_2d(spark, folder)
    units = _vectors(spark, folder).select(F.posexplode(vx.unit(F.col("embedding"))).alias("pos", "x"))
    spread = units.groupBy("pos").agg(F.var_samp("x").alias("v")).agg(F.sum("v")).scalar()
    share = (F.var_samp("pc1") + F.var_samp("pc2")) / spread * 100
    return found.agg(
        F.count("*").alias("n"),
        (F.abs(F.avg("pc1")) + F.abs(F.avg("pc2")) < 1e-6).alias("centred"),
        (F.abs(F.covar_samp("pc1", "pc2")) < 1e-6).alias("uncorrelated"),
        (F.var_samp("pc1") >= F.var_samp("pc2")).alias("ordered"),
        (F.abs(share - F.max("explained_pct")) < 0.02).alias("share_agrees"),
    )


def classifier_facts(spark, folder):
    """At the fitted optimum every class's mean probability is its share, both weighted."""
    rows = _vectors(spark, folder)
    model = classify.fit_classifier(rows, "label")
    scored = model.predict(rows).join(classify.class_weights(rows, "label").drop("n"), "label")
    names = scored.select("weight", F.col("label").cast("string"), F.explode("probabilities").alias("name", "p"))
    per_class = names.groupBy("name").agg(
        (F.sum(F.col("weight") * F.col("p")) / F.sum("weight")).alias("mean"),
        (F.sum(F.when(F.col("label") == F.col("name"), F.col("weight"))) / F.sum("weight")).alias("share"),
    )
    return per_class.agg(
        F.count("*").alias("classes"), F.max(F.abs(F.col("mean") - F.col("share")) < 1e-3).alias("means_agree")
    )


def probability_facts(spark, folder):
    """Every row's probabilities add up to one, and its intent is the likeliest class."""
    rows = _vectors(spark, folder)
    scored = classify.fit_classifier(rows, "label").predict(rows)
    shares = F.map_values("probabilities")
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    own = F.col("probabilities")[F.col("intent")]
    return scored.agg(
        F.count("*").alias("n"),
        F.count_if(F.abs(total - 1) > 1e-3).alias("off_total"),
        F.count_if((own < F.array_max(shares)) | (own != F.col("confidence"))).alias("off_intent"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        kmeans_assign,
        k_sweep,
        k_sweep_facts,
        stream_messages,
        stream_all_messages,
        kmeans_facts,
        pca_facts,
        classifier_facts,
        probability_facts,
        silhouette_squared,
        pca_2d,
        classify_intents,
        triage_prompts,
    )
}
ORACLE = {
    "stream_messages": vectors.ORACLE["topk_context"].replace("FROM cases e", "FROM known_cases e").replace(
        "hits AS (",
        "known_cases AS (SELECT * FROM cases WHERE conversation_id IN (SELECT vec_id FROM embeddings)),\nhits AS (",
    ).replace(" AS context\nFROM known", " AS context, true AS told\nFROM known"),
    "stream_all_messages": vectors.ORACLE["topk_context"].replace(" AS context\nFROM cases", " AS context, true AS told\nFROM cases"),
    "kmeans_facts": "SELECT count(*) AS n, 0::BIGINT AS misplaced, true AS costs_agree FROM embeddings",
    "k_sweep_facts": "SELECT k, count(*) AS n, k AS cells, true AS cost_agrees "
    "FROM embeddings, unnest(range(3, 8)) AS t(k) GROUP BY k",
    "pca_facts": "SELECT count(*) AS n, true AS centred, true AS uncorrelated, true AS ordered, "
    "true AS share_agrees FROM embeddings",
    "probability_facts": "SELECT count(*) AS n, 0::BIGINT AS off_total, 0::BIGINT AS off_intent FROM embeddings",
    "classifier_facts": "SELECT count(DISTINCT label) AS classes, true AS means_agree FROM embeddings",
    "silhouette_squared": f"""WITH {sql.UNIT},
gaps AS (
  SELECT a.vec_id, a.label AS own, b.label, pow(list_distance(a.u, b.u), 2) AS d
  FROM unit a JOIN unit b ON a.vec_id <> b.vec_id),
per_label AS (SELECT vec_id, own, label, avg(d) AS d FROM gaps GROUP BY ALL),
per_row AS (
  SELECT vec_id, max(CASE WHEN label = own THEN d END) AS a,
         min(CASE WHEN label <> own THEN d END) AS b
  FROM per_label GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS squared_silhouette
FROM per_row""",
}
