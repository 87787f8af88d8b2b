import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from parley import schemas
from parley.functions import grades
from parley.operators import classify, clusters, enrich, evaluate, retrieval
from parley.plans import corpus, evaluation, triage
from parley.streaming import triage as stream

# Workers cannot import this file, so the stand-in models below travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for label, center in enumerate(np.eye(3)):
        for i in range(20):
            vector = [float(x) for x in center + rng.normal(scale=0.05, size=3)]
            rows.append((label * 20 + i, vector, f"group{label}"))
    return spark.createDataFrame(rows, "id long, embedding array<double>, name string").cache()


def test_clusters_find_the_groups(blobs):
    found = clusters.cluster(blobs, k=3, n_init=3).groupBy("name", "cluster").count().collect()
    assert sorted(r["count"] for r in found) == [20, 20, 20]


def test_sweep_prefers_the_right_k(blobs):
    swept = clusters.sweep(blobs, "id", ks=(2, 3, 4), n_init=2, sample_size=40)
    assert clusters.best_k(swept).first()["k"] == 3
    costs = [r["inertia"] for r in swept.orderBy("k").collect()]
    assert costs[0] > costs[1]


def brute_silhouette(x, labels):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    scores = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(x)) != i)
        if not same.any():
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == c].mean() for c in set(labels) - {own})
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


@pytest.mark.parametrize("block", [7, 2048])
def test_silhouette_equals_brute_force(spark, blobs, block):
    rows = blobs.orderBy("id").collect()
    labels = np.array([0 if i == 0 else 1 + i % 3 for i in range(len(rows))])
    frame = spark.createDataFrame(
        [(r["id"], r["embedding"], int(l)) for r, l in zip(rows, labels)],
        "id long, embedding array<double>, l int",
    )
    got = clusters.silhouette(frame, "id", "embedding", ["l"], rows_per_block=block).first()
    wanted = brute_silhouette(np.array([r["embedding"] for r in rows]), labels)
    assert got["silhouette"] == pytest.approx(wanted, abs=1e-6)


def test_inertia_equals_kmeans_cost(blobs):
    points = clusters.features(blobs)
    model = clusters.fit_kmeans(points.select("features"), 3, n_init=1)
    labelled = clusters.assign(points, model)
    got = clusters.inertia(labelled, "cluster").first()["inertia"]
    assert got == pytest.approx(model.summary.trainingCost, abs=1e-4)


def test_representatives_rank_by_dot_with_the_mean(blobs):
    rows = blobs.collect()
    got = clusters.representatives(blobs, "id", "name").collect()
    for name in ("group0", "group1", "group2"):
        x = np.array([r["embedding"] for r in rows if r["name"] == name])
        ids = [r["id"] for r in rows if r["name"] == name]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        order = np.argsort(-(x @ x.mean(0)), kind="stable")[:3]
        mine = [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["name"] == name]
        assert mine == [ids[i] for i in order]


def test_projection_keeps_most_variance(blobs):
    out = clusters.project_2d(blobs, "id")
    row = out.agg(F.avg("pc1"), F.avg("pc2"), F.max("explained_pct"), F.count("*")).first()
    assert abs(row[0]) < 1e-5 and abs(row[1]) < 1e-5
    assert row[2] > 90 and row[3] == 60


def test_classifier(blobs):
    model = classify.fit_classifier(blobs, "name")
    out = model.predict(blobs)
    assert out.where("intent = name").count() == 60
    row = out.first()
    assert set(row["probabilities"]) == {"group0", "group1", "group2"}
    assert row["confidence"] == max(row["probabilities"].values())
    assert sum(row["probabilities"].values()) == pytest.approx(1, abs=2e-4)


def test_class_weights(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",), (None,)], "l string")
    got = {r["l"]: r["weight"] for r in classify.class_weights(rows, "l").collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": 2.0}


class Calls:
    """Counts calls through a file, since calls run in worker processes."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, row):
        with open(self.path, "a") as log:
            log.write(row["key"] + "\n")
        if row["key"] == "bad":
            raise ValueError("no answer")
        return json.dumps({"a": row["text"], "ok": True})

    def made(self):
        try:
            return sorted(open(self.path).read().split())
        except FileNotFoundError:
            return []


def test_answers_are_asked_once(spark, tmp_path):
    call = Calls(tmp_path / "log")
    path = str(tmp_path / "cache")
    first = spark.createDataFrame([("1", "x")], "key string, text string")
    assert enrich.answers(first, path, call).count() == 1
    rows = [("1", "x"), ("2", "y"), ("2", "y"), ("bad", "z")]
    more = spark.createDataFrame(rows, "key string, text string")
    got = {r["key"]: (r["raw"] is None, r["error"]) for r in enrich.answers(more, path, call).collect()}
    assert got == {"1": (False, None), "2": (False, None), "bad": (True, "ValueError: no answer")}
    assert call.made() == ["1", "2", "bad"]
    enrich.answers(more, path, call).count()
    assert call.made() == ["1", "2", "bad"]
    enrich.answers(more, path, call, retry_failures=True).count()
    assert call.made() == ["1", "2", "bad", "bad"]


def test_broken_answers_become_sentinels(spark):
    kind = schemas._struct(("a", schemas.STR), ("ok", schemas.BOOL))
    rows = spark.createDataFrame(
        [('{"a": "x", "ok": true}',), ('{"a": "x"}',), ("no json",), (None,)], "raw string"
    )
    out = enrich.with_parsed(rows, "raw", kind)
    assert [r["a"] for r in out.collect()] == ["x"] + [grades.JUDGE_FAILED] * 3
    row = enrich.failure_count(out, "a").first()
    assert tuple(row) == (4, 3)


def lengths():
    def predict(texts):
        return np.array([[len(t), t.count("a")] for t in texts], dtype="float32")

    return predict


def test_embedding_cache(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.createDataFrame([(1, "aa"), (2, None)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in enrich.embed_missing(rows, "id", "text", path, lengths).collect()}
    assert got == {1: [2.0, 2.0], 2: [0.0, 0.0]}
    more = spark.createDataFrame([(1, "changed"), (3, "b")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in enrich.embed_missing(more, "id", "text", path, lengths).collect()}
    assert got == {1: [7.0, 1.0], 3: [1.0, 0.0]}  # a changed text has a vector of its own
    other = enrich.embed_missing(rows, "id", "text", path, ones, model="ones")
    assert {r["id"]: r["embedding"] for r in other.collect()} == {1: [1.0], 2: [1.0]}


def ones():
    def predict(texts):
        return np.ones((len(texts), 1), dtype="float32")

    return predict


def test_unreadable_answers_are_retried(spark, tmp_path):
    kind = schemas._struct(("a", schemas.STR))
    rows = spark.createDataFrame([("1", "x")], "key string, text string")
    path = str(tmp_path / "cache")
    first = enrich.answers(rows, path, lambda row: "no json", schema=kind).first()
    assert (first["raw"], first["error"]) == ("no json", "unreadable answer")
    again = enrich.answers(rows, path, lambda row: '{"a": "y"}', retry_failures=True, schema=kind).first()
    assert (again["raw"], again["error"]) == ('{"a": "y"}', None)


def test_missing_answers_do_not_raise_recall(spark):
    rows = spark.createDataFrame(
        [("s", "a", "a", True, True), ("s", "a", None, True, None)],
        "system string, true_intent string, predicted_intent string, true_escalation boolean, "
        "predicted_escalation boolean",
    )
    row = evaluate.system_metrics(rows).first()
    assert (row["fn"], row["escalation_recall"]) == (1, 50.0)


def cases(spark):
    return spark.createDataFrame(
        [
            (1, [1.0, 0.0], "lost my song", "try http://t.co/x now", "app_bug", 4, True),
            (2, [0.9, 0.1], "song is gone", None, "app_bug", 4, True),
            (3, [0.0, 1.0], "pay twice", "we will refund", None, None, None),
        ],
        "conversation_id long, embedding array<float>, first_customer_text_clean string, "
        "last_brand_reply_clean string, intent_label string, cluster int, is_resolved boolean",
    )


def test_hits_and_context(spark):
    hits = retrieval.hits(cases(spark), cases(spark), k=2)
    rows = {(r["query_id"], r["rank"]): r for r in hits.collect()}
    assert rows[(2, 1)]["brand_reply"] == "try https://support.example.com now"
    assert rows[(1, 2)]["intent_label"] == "unknown" and rows[(1, 2)]["cluster"] == -1
    queries = spark.createDataFrame([(1,), (99,)], "conversation_id long")
    got = {r["conversation_id"]: r["context"] for r in retrieval.with_context(queries, hits).collect()}
    assert got[99] == retrieval.NO_CONTEXT
    assert got[1].startswith("Case 1 (app_bug, similarity 0.99)\nAsked: song is gone\n")
    assert got[1].count("\n\n") == 1


def test_default_reply(spark):
    sample = spark.createDataFrame([(1, "a"), (2, "b")], "conversation_id long, t string")
    threads = spark.createDataFrame([(1, "hello")], "conversation_id long, last_brand_reply_clean string")
    got = {r["conversation_id"]: r["last_brand_reply_clean"] for r in retrieval.build_corpus(sample, threads).collect()}
    assert got == {1: "hello", 2: retrieval.DEFAULT_REPLY}
    bare = retrieval.build_corpus(sample, None).select("last_brand_reply_clean").distinct().collect()
    assert [r[0] for r in bare] == [retrieval.NO_REPLIES]


def decide(row):
    return json.dumps(
        {
            "reasoning": "stand-in",
            "predicted_intent": "app_bug",
            "is_escalation": "refund" in row["prompt"],
            "escalation_reason": "r",
            "draft_reply": "d",
        }
    )


def test_triage_end_to_end(spark, tmp_path):
    rows = cases(spark)
    trained = classify.fit_classifier(rows.fillna("billing_dispute", ["intent_label"]), "intent_label")
    prompts = triage.triage_prompts(rows.drop("intent_label"), rows, trained, k=1)
    out = triage.triage(prompts, str(tmp_path / "a"), decide).collect()
    assert {r["conversation_id"] for r in out} == {1, 2, 3}
    assert all(r["predicted_intent"] == "app_bug" for r in out)
    assert {r["classifier_intent"] for r in out} <= {"app_bug", "billing_dispute"}
    assert all(len(r["retrieved_docs"]) == 1 for r in out)


def judge(row):
    if "poison" in row["prompt"]:
        raise RuntimeError("judge is down")
    names = [f.name for f in schemas.JUDGE_GRADES.fields]
    return json.dumps(dict.fromkeys(names, "incorrect") | {"rag_escalation": "correct_no_escalation"})


def test_judged_comparison(spark, tmp_path):
    truth = spark.createDataFrame(
        [(1, "poison", "a", False), (2, "text", "a", False)],
        "id long, t string, intent_label string, is_escalation boolean",
    )
    answers = truth.select(
        "id", F.lit("x").alias("system"), F.lit("a").alias("predicted_intent"),
        F.lit(False).alias("is_escalation"), F.lit("hi").alias("draft_reply"),
    )
    compared = evaluation.comparison(truth, {"rag": answers, "simp": answers}, "id", "t")
    rows = evaluation.judged(compared, str(tmp_path / "j"), judge, "id", "model")
    rates = evaluate.judge_rates(rows, {"rag": ("rag_judge_accuracy", "rag_judge_tone")}).first()
    assert (rates["judged"], rates["judge_failures"], rates["fully_correct_pct"]) == (1, 1, 0.0)
    both = rows.withColumn("human", F.lit(None).cast("string"))
    row = evaluation.agreement(both, "human", "rag_judge_escalation", "ground_truth_escalation").first()
    assert (row["n"], row["agreement_pct"]) == (1, 100.0)
    failed = evaluate.failures(rows, "rag_judge_accuracy", "rag_judge_escalation", "id").collect()
    assert [r["id"] for r in failed] == [2]


def test_failures_fall_back_to_the_lowest_grades(spark):
    rows = spark.createDataFrame(
        [(i, g, "correct_escalation") for i, g in enumerate(["fully_correct"] * 7 + ["JUDGE_FAILED"])],
        "id long, g string, e string",
    )
    assert [r["id"] for r in evaluate.failures(rows, "g", "e", "id").orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_kappa(spark):
    pairs = [("x", "x")] * 20 + [("y", "y")] * 15 + [("x", "y")] * 5 + [("y", "x")] * 10
    row = evaluate.kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first()
    assert row["kappa"] == pytest.approx(0.4) and row["agreement_pct"] == 70.0
    same = [("x", "x"), ("y", "y")]
    assert evaluate.kappa(spark.createDataFrame(same, "a string, b string"), "a", "b").first()["kappa"] == 1.0


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    schema = "id string, text string"
    rows = [(str(i), f"please refund http://x.y number {i}" if i % 2 else "hello  there") for i in range(10)]
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        messages = stream.read_messages(spark, source, spark.createDataFrame(rows, schema).schema, files=1)
        stream.write_batches(stream.score(messages, "id", "text"), sink, state).awaitTermination()
        return spark.read.parquet(sink).drop("batch")

    spark.createDataFrame(rows[:6], schema).coalesce(1).write.parquet(source)
    assert run().count() == 6
    spark.createDataFrame(rows[6:], schema).coalesce(1).write.mode("append").parquet(source)
    got = run()
    wanted = stream.score(spark.createDataFrame(rows, schema), "id", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_corpus_is_written(spark, tmp_path):
    tweets = spark.createDataFrame(
        [
            ("1", "c", True, "t", "my app is very broken", "2", None),
            ("2", "brand", False, "t", "from @help: sorry", None, "1"),
        ],
        schemas.TWEETS,
    )
    usable = corpus.write_corpus(tweets, "@help", str(tmp_path))
    assert [r["conversation_id"] for r in usable.collect()] == ["1"]
    assert usable.first()["last_brand_reply_clean"] == "from @help: sorry"
    assert len(list((tmp_path / "customer_messages_csv").glob("part-*.csv"))) == 1
