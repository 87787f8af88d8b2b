"""Array files and rows beside each other by position."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException, PySparkException
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from parley.sources import arrays, positions


def test_reads_ranges_of_a_numpy_file(spark, tmp_path):
    for kind in ("<f4", "<f8"):
        x = np.random.default_rng(1).normal(size=(1000, 7)).astype(kind)
        np.save(tmp_path / f"x{kind[1:]}.npy", x)
        frame = arrays.read_arrays(spark, str(tmp_path / f"x{kind[1:]}.npy"), range_bytes=3000)
        assert frame.rdd.getNumPartitions() > 5
        rows = sorted(frame.collect())
        assert [r.position for r in rows] == list(range(1000))
        assert np.array_equal(np.array([r.embedding for r in rows]), x.astype("f8"))


def test_folder_in_the_order_of_names(spark, tmp_path):
    parts = [np.full((n, 2), float(i)) for i, n in enumerate((3, 0, 5))]
    for i, part in enumerate(parts):
        np.save(tmp_path / f"{i}.npy", part)
    rows = sorted(arrays.read_arrays(spark, f"file://{tmp_path}", 16).collect())
    assert [(r.position, r.embedding[0]) for r in rows] == [(i, 0.0 if i < 3 else 2.0) for i in range(8)]


@pytest.mark.parametrize(
    "bad", [np.zeros((3, 2), "<i8"), np.zeros(4), np.asfortranarray(np.ones((3, 2))), np.zeros((2, 2), ">f4")]
)
def test_other_files_are_refused(tmp_path, bad):
    np.save(tmp_path / "x.npy", bad)
    with pytest.raises(ValueError, match="C order"):
        arrays.ArrayReader({"path": str(tmp_path)}).partitions()


def test_short_and_uneven_files_are_refused(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.zeros((100, 2)))
    body = (tmp_path / "x.npy").read_bytes()
    (tmp_path / "x.npy").write_bytes(body[:-8])
    with pytest.raises((PySparkException, AnalysisException, Py4JError), match="ends before"):
        arrays.read_arrays(spark, str(tmp_path)).count()
    np.save(tmp_path / "x.npy", np.zeros((3, 2)))
    np.save(tmp_path / "y.npy", np.zeros((3, 5)))
    with pytest.raises(ValueError, match="different lengths"):
        arrays.ArrayReader({"path": str(tmp_path)}).partitions()


def test_write_then_read_by_position(spark, tmp_path):
    rows = [(i * 7 % 1009, [float(i), -float(i), 0.5]) for i in range(1009)]
    frame = spark.createDataFrame(rows, "key long, v array<double>").repartition(5)
    assert arrays.write_arrays(frame, "key", "v", str(tmp_path / "a"), file_rows=100) == 1009
    assert max(arrays.header_of("", str(p)).rows for p in (tmp_path / "a").glob("*.npy")) <= 100
    keys = positions.numbered(frame.select("key"), "key")
    got = positions.beside(keys, arrays.read_arrays(spark, str(tmp_path / "a"), 500))
    assert sorted((r.key, r.embedding) for r in got.collect()) == sorted(rows)


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).select((F.hash("id") % 100).alias("a"), "id").repartition(9)
    got = [(r.a, r.id) for r in positions.numbered(rows, "a", "id").orderBy("position").collect()]
    assert got == sorted(got) and len(got) == 5000
    places = [r.position for r in positions.numbered(rows, "a", "id").collect()]
    assert sorted(places) == list(range(5000))
    assert positions.numbered(rows.limit(0), "a").count() == 0


def test_beside_refuses_other_lengths(spark):
    a, b = (positions.numbered(spark.range(n), "id") for n in (10, 11))
    with pytest.raises(ValueError, match="beside"):
        positions.beside(a, b)
    gap = b.where("position <> 5")
    with pytest.raises(ValueError, match="beside"):
        positions.beside(a, gap)
    same = positions.beside(a.withColumnRenamed("id", "left"), a)
    assert same.where("left = id").count() == 10
