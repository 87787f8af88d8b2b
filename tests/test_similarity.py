"""Every search path against brute force, with ties, hot groups and empty sides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import similarity as sim
from parley.operators import tfidf


def frame(spark, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def brute(corpus, queries, k, exclude_self=False):
    def unit(m):
        lengths = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(lengths > 0, lengths, 1)

    scores = np.round(unit(queries) @ unit(corpus).T, sim.DIGITS) + 0.0
    found = set()
    for q, row in enumerate(scores):
        order = sorted((-s, i) for i, s in enumerate(row) if not (exclude_self and i == q))
        found |= {(q, i, float(-s), r) for r, (s, i) in enumerate(order[:k], 1)}
    return {(q, i, round(s, 5), r) for q, i, s, r in found}


def rows_of(hits):
    return {
        (r["query_id"], r["id"], round(r["similarity"] + 0.0, 5), r["rank"]) for r in hits.collect()
    }


@pytest.fixture(scope="module")
def points():
    """A third of the rows are copies of one vector; one row is all zero."""
    rng = np.random.default_rng(7)
    matrix = rng.normal(size=(240, 8))
    matrix[40:120] = matrix[40]
    matrix[5] = 0.0
    return matrix


@pytest.mark.parametrize("exclude_self", [True, False])
def test_broadcast_search(spark, points, exclude_self):
    corpus = frame(spark, points).repartition(5)
    got = rows_of(sim.topk(corpus, corpus, 4, exclude_self=exclude_self))
    assert got == brute(points, points, 4, exclude_self)


def test_small_chunks_change_nothing(spark, points, monkeypatch):
    monkeypatch.setattr(sim, "SCORE_CELLS", 900)
    monkeypatch.setattr(sim, "PROBE_ROWS", 40)
    corpus = frame(spark, points)
    wanted = brute(points, points, 3, True)
    assert rows_of(sim.topk(corpus, corpus, 3, exclude_self=True)) == wanted
    assert rows_of(sim.cell_topk(corpus, corpus, 3, True, cells=9)) == wanted
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").coalesce(1)
    vocabulary = tfidf.fit(docs)
    vectors = reference_vectors(TEXTS, vocabulary)
    monkeypatch.setattr(sim, "SCORE_CELLS", 2 * len(vocabulary.terms))
    hits = tfidf.nearest(docs, docs, "id", "text", vocabulary=vocabulary, exclude_self=True)
    assert rows_of(hits) == brute(vectors, vectors, 1, True)


@pytest.mark.parametrize("cells, block", [(1, 7), (6, 16), (240, 4096)])
def test_cell_search(spark, points, cells, block):
    corpus = frame(spark, points)
    hits = sim.cell_topk(corpus, corpus, 3, True, cells=cells, rows_per_block=block)
    assert rows_of(hits) == brute(points, points, 3, True)


def test_many_queries_leave_the_broadcast(spark, points):
    corpus = frame(spark, points)
    hits = sim.topk(corpus, corpus, 3, exclude_self=True, broadcast_bytes=640)
    assert rows_of(hits) == brute(points, points, 3, True)


def test_clustered_points_skip_cells(spark):
    """Far cells are ruled out, and the result stays whole."""
    rng = np.random.default_rng(3)
    centers = np.eye(6)
    matrix = np.vstack([c + rng.normal(scale=0.02, size=(40, 6)) for c in centers])
    corpus = frame(spark, matrix)
    hits = sim.cell_topk(corpus, corpus, 2, True, cells=12, rows_per_block=8)
    assert rows_of(hits) == brute(matrix, matrix, 2, True)


def test_far_cells_are_ruled_out():
    angles = np.array([[0.1, 1.4, 1.5, 0.6]])
    radius = np.array([0.2, 0.2, 0.2, 0.2])
    size = np.array([10, 10, 10, 0])
    home = sim._cells_to_search(angles, radius, size, 3, None)
    assert home.tolist() == [[True, False, False, False]]
    assert not sim._cells_to_search(angles, radius, size, 3, np.array([0.5])).any()
    more = sim._cells_to_search(angles, radius, size, 3, np.array([1.25]))
    assert more.tolist() == [[False, True, False, False]]
    assert sim._cells_to_search(angles, radius, size, 25, None).tolist() == [[True, True, True, False]]


def test_fewer_rows_than_k(spark):
    corpus = frame(spark, np.eye(2))
    for hits in (sim.topk(corpus, corpus, 5, exclude_self=True), sim.cell_topk(corpus, corpus, 5, True)):
        assert hits.count() == 2
    empty = corpus.limit(0)
    assert sim.topk(corpus, empty, 3).count() == 0
    assert sim.topk(empty, corpus, 3).count() == 0
    assert sim.cell_topk(empty, corpus, 3).count() == 0


def test_ties_go_to_the_lowest_id(spark):
    corpus = frame(spark, [[1.0, 0.0]] * 5, ids=[9, 3, 7, 1, 5]).repartition(5)
    query = frame(spark, [[2.0, 0.0]], ids=[100])
    assert [r["id"] for r in sim.topk(corpus, query, 3).orderBy("rank").collect()] == [1, 3, 5]


def test_string_ids(spark):
    rows = [(f"m{i}", v) for i, v in enumerate(np.eye(3).tolist())]
    corpus = spark.createDataFrame(rows, "id string, vec array<double>")
    hits = sim.topk(corpus, corpus, 1, exclude_self=True)
    assert {(r["query_id"], r["id"]) for r in hits.collect()} == {("m0", "m1"), ("m1", "m0"), ("m2", "m0")}


TEXTS = ["the cat sat", "the dog sat", "a bird flew", "cat and dog and cat", "", "zebra"]


def reference_vectors(texts, vocabulary):
    import re

    index = {t: i for i, t in enumerate(vocabulary.terms)}
    out = np.zeros((len(texts), len(index)))
    for row, text in enumerate(texts):
        for token in re.findall(r"\w\w+", text.lower()):
            if token in index:
                out[row, index[token]] += vocabulary.idf[index[token]]
    return out


def test_tfidf_vocabulary_and_weights(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    full = tfidf.fit(docs)
    assert list(full.terms) == sorted(full.terms)
    idf = dict(zip(full.terms, full.idf))
    assert idf["cat"] == pytest.approx(np.log(7 / 3) + 1)
    short = tfidf.fit(docs, max_features=3, stop_words=("the",))
    assert list(short.terms) == ["and", "cat", "dog"]
    weights = {
        (r["id"], r["term"]): r["weight"] for r in tfidf.weights(docs, "id", "text", full).collect()
    }
    unit = reference_vectors(TEXTS, full)
    unit /= np.where(np.linalg.norm(unit, axis=1, keepdims=True) > 0, np.linalg.norm(unit, axis=1, keepdims=True), 1)
    for (i, term), w in weights.items():
        assert w == pytest.approx(unit[i, list(full.terms).index(term)])
    assert len(weights) == (unit > 0).sum()


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 100])
def test_tfidf_nearest(spark, broadcast_bytes):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    vocabulary = tfidf.fit(docs)
    hits = tfidf.nearest(
        docs, docs, "id", "text", vocabulary=vocabulary, exclude_self=True, broadcast_bytes=broadcast_bytes
    )
    vectors = reference_vectors(TEXTS, vocabulary)
    assert rows_of(hits) == brute(vectors, vectors, 1, True)


def test_text_without_known_words_gets_the_lowest_id(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    query = spark.createDataFrame([(77, "nothing known")], "id long, text string")
    row = tfidf.nearest(docs, query, "id", "text").first()
    assert (row["id"], row["similarity"]) == (0, 0.0)


def test_neighbour_answer(spark):
    docs = spark.createDataFrame(
        [(0, "refund my card", "billing", "sorry"), (1, "app crashes", "bug", "reinstall")],
        "id long, text string, intent string, reply string",
    )
    query = spark.createDataFrame([(9, "the app crashes again")], "id long, text string")
    near = tfidf.nearest(docs, query, "id", "text")
    row = tfidf.neighbour_answers(near, docs, "id", "text", "intent", "reply").first()
    assert (row["id"], row["predicted_intent"], row["draft_reply"]) == (9, "bug", "reinstall")
    assert row["retrieved_context"] == "Matched nearest neighbor (sim=1.00): app crashes"


def test_null_vectors_have_no_neighbours(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, None)], "k long, e array<float>")
    assert sim.dense(rows, "k", "e").count() == 1
    assert sim.dense(rows, "k", "e").schema["vec"].dataType.elementType.simpleString() == "double"
    assert F is not None


def test_ragged_and_nan_vectors(spark):
    nan = float("nan")
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [nan, 1.0]), (4, None), (5, [0.6, 0.8]), (6, [1.0, None])],
        "i int, v array<double>",
    )
    points = sim.dense(rows, "i", "v")
    got = sim.topk(points, points.where("id = 1"), 2, exclude_self=True).collect()
    assert [(r["id"], r["similarity"]) for r in got] == [(5, 0.6), (2, 0.0)]
    bad = {(r["id"], r["reason"]) for r in sim.unusable(rows, "i", "v", 2).collect()}
    assert bad == {(3, "not a number"), (4, "missing"), (6, "not a number")}
    ragged = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0, 0.0])], "i int, v array<double>")
    points = sim.dense(ragged.coalesce(1), "i", "v")
    with pytest.raises(Exception, match="different lengths"):
        sim.topk(points, points, 1).collect()


@pytest.mark.parametrize("exclude_self", [False, True])
def test_equal_rows_are_searched_once(spark, exclude_self):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 5))
    rows = [(i, base[i % 12 if i > 60 else 0].tolist()) for i in range(120)]
    points = sim.dense(spark.createDataFrame(rows, "i int, v array<double>"), "i", "v")
    plain = sim.topk(points, points, 3, exclude_self=exclude_self)
    other = sim.distinct_topk(points, points, 3, exclude_self=exclude_self)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, other.collect()))
