"""Multi-line CSV read by ranges against the one-task reader."""

import csv
import random

import pytest

from parley.sources import ranges, sinks, tables

SCHEMA = "id bigint, name string, body string, n int"


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def write(path, rows, end="\r\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, lineterminator=end)
        out.writerow(["id", "name", "body", "n"])
        out.writerows(rows)


def texts(rnd, n):
    pieces = ["word", '"', "\n", "\r\n", ",", " ", "é", '""', "\n\n", "plain text"]
    for i in range(n):
        long = 3000 if rnd.random() < 0.02 else 12
        yield i, rnd.choice(["a", "b,c", 'd"e']), "x" + "".join(rnd.choices(pieces, k=rnd.randrange(long))) + "y", i % 7


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_ranges_equal_the_rows_written(spark, tmp_path, small_ranges, end):
    rows = list(texts(random.Random(1), 500))
    for part in range(3):
        write(tmp_path / f"part{part}.csv", rows[part::3], end)
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 10
    got = sorted(tuple(r) for r in ranges.read_csv(spark, str(tmp_path), schema(spark)).collect())
    assert got == rows


def test_equals_the_one_task_reader(spark, tmp_path, small_ranges):
    rows = [(i, f"n{i}", f'line "one"\nline two, {i}\n' * (i % 5) + "end", None) for i in range(300)]
    write(tmp_path / "one.csv", rows, "\n")
    want = sorted(map(str, tables.read_csv(spark, str(tmp_path), schema(spark)).collect()))
    assert sorted(map(str, ranges.read_csv(spark, str(tmp_path), schema(spark)).collect())) == want


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = "\n".join(f'line "{i}" of a long field' for i in range(2000))
    rows = [(1, "a", "short", 1), (2, "b", long, 2), (3, "c", "short\nagain", 3), (4, "d", long + "\n", 4)]
    write(tmp_path / "one.csv", rows, "\n")
    got = sorted(tuple(r) for r in ranges.read_csv(spark, str(tmp_path), schema(spark)).collect())
    assert got == rows


def test_byte_order_mark_empty_lines_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name,body,n\n1,a,"x\n\ny",2\n\n\n2,b,,3', encoding="utf-8")
    (tmp_path / "b.csv").write_text("", encoding="utf-8")
    (tmp_path / "c.csv").write_text("id,name,body,n\n", encoding="utf-8")
    got = sorted(tuple(r) for r in ranges.read_csv(spark, str(tmp_path), schema(spark)).collect())
    assert got == [(1, "a", "x\n\ny", 2), (2, "b", None, 3)]


def test_quoted_header_over_lines(spark, tmp_path, small_ranges):
    head = '"id\n' + "x" * 5000 + '\n",name,body,n\n'
    (tmp_path / "a.csv").write_text(head + "1,a,b,2\n" * 3, encoding="utf-8")
    assert ranges.read_csv(spark, str(tmp_path), schema(spark)).count() == 3


def test_written_by_the_sink(spark, tmp_path, small_ranges):
    rows = spark.createDataFrame([(i, "a", f'q"{i}"\nz', i) for i in range(50)], SCHEMA).repartition(4)
    sinks.write_csv(rows, str(tmp_path / "out"), bom=True)
    got = ranges.read_csv(spark, str(tmp_path / "out"), rows.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
