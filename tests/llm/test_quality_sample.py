"""What the quality models learn from: all n-gram sizes, and slots counted by the tasks."""

import random
import zlib

import numpy as np
import pytest

from parley.llm import quality


def rows_of(n, seed):
    """Toxic rows hold three letters inside words that nothing else is common to."""
    rnd, out = random.Random(seed), []

    def strange():
        return chr(0x4E00 + rnd.randrange(20_000))

    for i in range(n):
        bad = i % 4 == 0
        words = [strange() + ("zqx" if bad and k % 9 == 4 else strange()) + strange() for k in range(60)]
        out.append((i, " ".join(words), rnd.randrange(2), int(bad)))
    return out


def tables(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_sizes_and_sample():
    assert quality.LETTERS == range(3, 7) and quality.SAMPLE_ROWS == 6000


def test_three_letters_are_learned(spark):
    rows = rows_of(400, 1)
    models = quality.train(*tables(spark, rows))
    table = models["toxic"].table()
    for _, text, _, bad in rows_of(60, 2):
        p = models["toxic"].probability(models["toxic"].margin(table, quality.slots(text)))
        assert (p > quality.TOXIC) == bool(bad)


def test_counts_of_tasks_give_the_same_model(spark):
    rows = rows_of(300, 3)
    rows = [(i, t + (" fine plain words" if good else " cheap pills now"), good, bad) for i, t, good, bad in rows]
    got = quality.train(*tables(spark, rows))
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0])))
    found = [quality.packed(quality.slots(r[1])) for r in rows]
    for name, y in (("low_quality", [1.0 - r[2] for r in rows]), ("toxic", [1.0 * r[3] for r in rows])):
        want = quality.fit(found, np.array(y))
        assert np.array_equal(got[name].places, want.places) and len(want.places)
        assert np.allclose(got[name].weights, want.weights) and got[name].line == pytest.approx(want.line)
