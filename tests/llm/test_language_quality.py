"""Language identification and quality rules: held-out accuracy, brute force, edge rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from parley.llm import language, ngrams, quality

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, key int, id string, name string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "i", "n") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_kernel_is_the_presence_kernel():
    letters = ngrams.letter_table()
    texts = ["The cat sat.", "the dog sat!", "Chat noir", "x"]

    def gram_set(text):
        line = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
        return {line[i : i + n] for n in language.SIZES for i in range(len(line) - n + 1)}

    rows = np.stack(
        [ngrams.presence(ngrams.letters_only(t, letters), language.SIZES, language.BITS) for t in texts]
    ).astype(float)
    sets = [gram_set(t) for t in texts]
    want = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets]
    assert np.allclose(language.kernel(rows, rows), want, atol=0.02)


def test_language_of_held_out_rows(spark, docs):
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_language_edges(spark):
    english = [(i, "the cat and the dog were in the house", "en") for i in range(1, 30)]
    spanish = [(i, "el perro y el gato estaban en la casa", "es") for i in range(30, 60)]
    odd = [
        (101, None, "en"),
        (102, "", "es"),
        (103, "123 !?", None),
        (None, "the house and the cat", "en"),
        (104, "en la casa del gato", None),
        (104, "en la casa del gato", None),
        (105, "the dog " * 50_000, None),
    ]
    rows = language.identify(frame(spark, english + spanish + odd)).collect()
    assert len(rows) == 59 + len(odd)
    found = {r.doc_id: r for r in rows}
    for key in (101, 102, 103):
        assert (found[key].lang_pred, found[key].score) == ("und", 0.0)
    assert found[104].lang_pred == "es" and found[105].lang_pred == "en"
    assert sum(r.doc_id == 104 for r in rows) == 2
    assert found[None].lang_pred == "en" and found[None].held_out is None


def test_language_without_labels(spark):
    empty = frame(spark, [(1, "x", "en")]).limit(0)
    assert language.identify(empty).collect() == []
    rows = language.identify(frame(spark, [(1, "hello there", None)])).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]


def by_hand(text):
    """The counted rules as they are stated, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_counts_against_brute_force():
    rnd = random.Random(2)
    pool = ["a", "b", "Ü", "#x", "\n", "\n", " ", "\t", "\x0b", "\x1c", "\xa0", "|", "<b>", "word"]
    texts = ["".join(rnd.choices(pool, k=rnd.randrange(80))) for _ in range(400)]
    for text in [*texts, None, "", " \n ", "a b c " * 3000]:
        assert quality.counted(text) == by_hand(text)


def test_quality_on_given_tables(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judge(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        counts = by_hand(texts[r.doc_id])
        assert tuple(r[1:6]) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
    marks = {r.doc_id: r for r in labels.collect()}
    clean = [r for r in rows if r.doc_id in marks and not r.base_failed]
    clean = [r for r in clean if marks[r.doc_id].quality and not marks[r.doc_id].toxic]
    assert sum(r.kept for r in clean) / len(clean) > 0.97


def test_classifier_on_rows_it_has_not_seen():
    rnd = random.Random(8)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(900):
        bad = rnd.random() < 0.3
        words = rnd.choices(plain, k=80) + (rnd.choices(["nasty", "vile", "awful"], k=3) if bad else [])
        rnd.shuffle(words)
        rows.append((quality.slots(" ".join(words)), float(bad)))
    model = quality.fit([quality.packed(s) for s, _ in rows[:600]], np.array([y for _, y in rows[:600]]))
    table = model.table()
    odds = [model.probability(model.margin(table, s)) for s, _ in rows[600:]]
    right = [(p > 0.5) == (y > 0) for p, (_, y) in zip(odds, rows[600:])]
    assert sum(right) / len(right) > 0.97
    expected, seen = sum(odds), sum(y for _, y in rows[600:])
    assert abs(expected - seen) / len(odds) < 0.05  # calibrated


def test_quality_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "x"), (2, "", "x"), (None, long, "x"), (3, long, "x"), (3, long, "x"), (4, "a b c " * 50, "x")]
    labels = spark.createDataFrame(
        [(1, 0, 1, 5), (None, 1, 0, 5), (9, 1, 0, 5), (3, None, 0, 5)],
        "doc_id long, quality int, toxic int, id int",
    )
    got = sorted(quality.judge(frame(spark, rows), labels).collect(), key=str)
    assert [(r.doc_id, r.base_failed, r.kept) for r in got if r.doc_id != 3] == [
        (1, True, False), (2, True, False), (4, True, False), (None, False, True),
    ]
    assert [r.kept for r in got if r.doc_id == 3] == [True, True]
    assert quality.judge(frame(spark, rows).limit(0), labels).collect() == []
