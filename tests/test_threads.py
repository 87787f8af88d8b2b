import pytest
from pyspark.sql import functions as F

from parley import schemas
from parley.operators import threads

BRAND = "brand"


def tweet(i, author, replies=None, parent=None, text=None, inbound=None):
    inbound = author != BRAND if inbound is None else inbound
    return (i, author, inbound, f"at {i}", text or f"text {i}", replies, parent)


@pytest.fixture
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schemas.TWEETS)


def paths(pool, **options):
    rows = threads.walk(pool, **options).orderBy("root_id", "turn_index").collect()
    found = {}
    for r in rows:
        found.setdefault(r["root_id"], []).append(r["tweet_id"])
    return found


def test_walk_stops_at_cycles_and_missing_nodes(make):
    pool = make(
        tweet("1", "c", "2"),
        tweet("2", BRAND, "3", "1"),
        tweet("3", "c", "2", "2"),
        tweet("10", "d", "11"),
        tweet("11", BRAND, "99", "10"),
    )
    assert paths(pool) == {"1": ["1", "2", "3"], "10": ["10", "11"]}


def test_walk_tries_only_the_first_child(make):
    pool = make(tweet("1", "c", "5, 6"), tweet("6", BRAND, None, "1"))
    assert paths(pool) == {"1": ["1"]}
    both = make(tweet("1", "c", " 6 ,5"), tweet("6", BRAND, None, "1"), tweet("5", BRAND, None, "1"))
    assert paths(both)["1"] == ["1", "6"]


def test_walk_is_capped(make):
    chain = [
        tweet(f"n{i:02}", "c" if i % 2 == 0 else BRAND, f"n{i + 1:02}", f"n{i - 1:02}" if i else None)
        for i in range(12)
    ]
    found = paths(make(*chain))
    assert found["n00"] == [f"n{i:02}" for i in range(10)]
    assert paths(make(*chain), max_turns=3)["n00"] == ["n00", "n01", "n02"]


def test_many_ended_threads_do_not_meet_in_one_task(spark, make):
    pool = make(*[tweet(str(i), "c") for i in range(400)])
    spread = pool.select(
        threads.spread_null(F.lit(None).cast("string"), F.col("tweet_id")).alias("k")
    )
    assert spread.distinct().count() == 400
    assert len(paths(pool)) == 400


def test_roots(make):
    pool = make(
        tweet("1", "c"),
        tweet("2", "c", parent="outside"),
        tweet("3", "c", parent="1"),
        tweet("4", BRAND, parent="outside"),
    )
    assert {r["tweet_id"] for r in threads.roots(pool).collect()} == {"1", "2"}


def test_pool_keeps_the_reply_of_an_id_seen_twice(make):
    tweets = make(
        tweet("1", "c", "2"),
        tweet("2", BRAND, "3", "1"),
        tweet("3", BRAND, None, "2"),
        tweet("7", "someone else"),
    )
    pool = threads.brand_pool(tweets, BRAND)
    assert sorted(r["tweet_id"] for r in pool.collect()) == ["1", "2", "3"]


def test_pool_drops_exact_copies(make):
    tweets = make(tweet("1", "c", "2"), *[tweet("2", BRAND, None, "1")] * 3)
    assert threads.brand_pool(tweets, BRAND).count() == 2


def test_fold_of_an_open_thread(make):
    tweets = make(
        tweet("1", "c", "2", None, "  hello there "),
        tweet("2", BRAND, "3", "1", "hi"),
        tweet("3", "c", "4", "2", "thanks"),
        tweet("4", BRAND, None, "3", "bye", inbound=False),
    )
    pool = threads.brand_pool(tweets, BRAND)
    row = threads.fold(threads.walk(pool, max_turns=3), pool, BRAND).first()
    assert row["conversation_id"] == "1"
    assert row["num_turns"] == 3
    assert row["first_customer_text"] == "hello there"
    assert row["last_brand_reply"] == "hi"
    assert row["is_resolved"] is False
    assert row["created_at"] == "at 1"
    assert row["conversation_text"] == "CUSTOMER: hello there | BRAND: hi | CUSTOMER: thanks"


def test_threads_of_one_turn_are_dropped(make):
    pool = make(tweet("1", "c"))
    assert threads.fold(threads.walk(pool), pool, BRAND).count() == 0


def test_usable_threads(spark):
    base = "conversation_id string, first_customer_text string, last_brand_reply string"
    rows = [
        ("3", "same words again here", "r"),
        ("2", "same  words again here http://x.y", "r"),
        ("4", "too short", "r"),
        ("5", None, None),
    ]
    kept = threads.usable_threads(spark.createDataFrame(rows, base)).collect()
    assert [r["conversation_id"] for r in kept] == ["2"]
    assert kept[0]["customer_word_count"] == 4


def test_brand_author_breaks_ties_by_id(make):
    tweets = make(
        tweet("1", "b", text="Ask @Help now", inbound=False),
        tweet("2", "a", text="@HELP", inbound=False),
        tweet("3", "z", text="@help @help", inbound=True),
        tweet("4", "y", text="nothing", inbound=False),
        ("5", "x", None, "t", "@help", None, None),
        ("6", "w", False, "t", None, None, None),
    )
    row = threads.brand_author(tweets, "help").first()
    assert (row["author_id"], row["n"]) == ("a", 1)
    assert threads.brand_counts(tweets, "help").count() == 2
