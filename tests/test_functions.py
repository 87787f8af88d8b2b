import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import grades
from parley.functions import text as tx
from parley.functions import vectors as vx


def one(spark, value, expression, kind="string"):
    frame = spark.createDataFrame([(value,)], f"c {kind}")
    return frame.select(expression(F.col("c")).alias("x")).first()["x"]


def python_clean(text):
    if text is None:
        return ""
    return re.sub(r"\s+", " ", re.sub(r"http\S+|www\S+", "", text)).strip()


@pytest.mark.parametrize(
    "text, wanted",
    [
        (None, ""),
        ("a  http://x b", "a b"),
        ("www.x.y", ""),
        ("a  b\x1cc", "a b c"),
        (" \n one\n\ntwo \t", "one two"),
        ("http", "http"),
    ],
)
def test_clean(spark, text, wanted):
    assert one(spark, text, tx.clean_text) == wanted


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.text(
            alphabet=st.sampled_from(list("ab w.é\n\t\x0b\x1c\x1f\x85\xa0 　​http:/ ")),
            max_size=40,
        ),
        min_size=1,
        max_size=20,
    )
)
def test_clean_equals_python_and_is_idempotent(spark, texts):
    texts = [*texts, *("www" + t for t in texts), *("http" + t for t in texts)]
    frame = spark.createDataFrame([(t,) for t in texts], "c string")
    once = tx.clean_text(F.col("c"))
    rows = frame.select("c", once.alias("x"), tx.strip(F.col("c")).alias("s"),
                        tx.word_count(once).alias("n")).collect()
    for r in rows:
        assert r["x"] == python_clean(r["c"])
        assert r["s"] == r["c"].strip()
        assert r["n"] == len(r["x"].split())


@pytest.mark.parametrize("text, n", [("", 0), ("a", 1), ("a b", 2)])
def test_word_count(spark, text, n):
    assert one(spark, text, tx.word_count) == n


def test_ids(spark):
    assert one(spark, " 1 , 2,", tx.split_ids) == ["1", "2"]
    assert one(spark, " 1 , 2", tx.first_id) == "1"
    assert one(spark, "", tx.first_id) is None
    assert one(spark, None, tx.first_id) is None


def test_flags_and_blanks(spark):
    for text, wanted in [("True", True), ("0", False), (" FALSE ", False), ("yes", None), (None, None)]:
        assert one(spark, text, tx.parse_flag) is wanted
    for text, wanted in [(None, True), ("  ", True), ("nan", True), ("x", False)]:
        assert one(spark, text, tx.is_blank) is wanted


def test_shortlinks(spark):
    hosts = ("shr.tn", "t.co")
    out = one(
        spark,
        "see https://t.co/abc, or http://shr.tn/x and https://t.com/y https://shrxtn/z",
        lambda c: tx.rewrite_shortlinks(c, hosts, "https://help"),
    )
    assert out == "see https://help or https://help and https://t.com/y https://shrxtn/z"


def test_keywords(spark):
    words = ("hack", "hacked", "refund")
    found = one(spark, "I was hacked, refund!", lambda c: tx.keyword_hits(F.lower(c), words))
    assert found == ["hack", "hacked", "refund"]
    assert one(spark, "discharge", lambda c: tx.contains_any(c, ("charge",))) is True


def test_patterns_match_whole_words(spark):
    pattern = (r"\bhack(ed)?\b", r"\bcharged .* not free\b")

    def hit(text):
        return one(spark, text, lambda c: tx.matches_any(c, pattern))

    assert hit("i was hacked.") and hit("hack") and hit("charged x not free")
    assert not hit("hacking") and not hit("éhack") and not hit("hack_1")
    assert not hit("charged\nnot free")
    assert hit("charged \x85 not free")
    for text, wanted in [("foo x", True), ("x bar", True), ("xbar", True), ("xfoo", False)]:
        assert one(spark, text, lambda c: tx.matches_any(c, (r"\bfoo|bar\b",))) is wanted


def test_first_letters_only_when_every_pattern_has_one():
    assert tx._first_letters(["hack(ed)?", "charged .* x", "check your dms?"]) == "(?=[ch])"
    for words in (["s?foo"], ["(a|b)c"], ["", "x"], [r"\d+"], ["x*y"]):
        assert tx._first_letters(words) == ""
    assert tx._first_letters(["changed my (email|password)"]) == "(?=[c])"


def test_tokens(spark):
    assert one(spark, "A to-do: É_x 12 ñ", tx.tokens) == ["to", "do", "é_x", "12"]


def test_decimals(spark):
    for value, wanted in [(0.125, "0.13"), (0.285, "0.29"), (-0.001, "0.00"), (1.0, "1.00")]:
        assert one(spark, value, tx.decimals, "double") == wanted


def test_vectors(spark):
    kind = "array<float>"
    assert one(spark, [3.0, 4.0], vx.unit, kind) == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0, 0.0], vx.unit, kind) == [0.0, 0.0]
    assert one(spark, [3.0, 4.0], vx.norm, kind) == 5.0
    assert one(spark, [3.0, 4.0], lambda c: vx.dot(c, c), kind) == 25.0


def test_grades(spark):
    rows = spark.createDataFrame(
        [(t, p) for t in (True, False) for p in (True, False)], "t boolean, p boolean"
    )
    got = [r[0] for r in rows.select(grades.escalation_grade(F.col("t"), F.col("p"))).collect()]
    assert got == [
        "correct_escalation",
        "missed_escalation",
        "unnecessary_escalation",
        "correct_no_escalation",
    ]
    for kappa, start in [(0.9, "Near"), (0.7, "Subst"), (0.4, "Moder"), (0.1, "Fair agreement (Kappa = 0.100)")]:
        assert one(spark, kappa, grades.agreement_strength, "double").startswith(start)


def test_whole_words_skip_escapes_and_classes(spark):
    rows = spark.createDataFrame([("xb",), ("a(",), ("zz",)], "s string")
    got = [r[0] for r in rows.select(tx.matches_any(F.col("s"), [r"\ba\(|b\b"])).collect()]
    assert got == [True, True, False]
    assert tx._is_whole_word(r"\b(?:a|[|)]b)\b") and not tx._is_whole_word(r"\ba[(]|b\b")
