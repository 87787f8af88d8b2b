"""Tables as streams: a table may be one file or a folder of files."""

import pytest

from parley.streaming import triage


@pytest.mark.parametrize("parts", [None, 3])
def test_tables_of_one_file_or_many(spark, tmp_path, parts):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id long, text string")
    path = tmp_path / "in" / "documents.parquet"
    if parts:
        rows.repartition(parts).write.parquet(str(path))
    else:
        path.parent.mkdir()
        rows.toPandas().to_parquet(path)
    rows.limit(3).write.parquet(str(tmp_path / "in" / "other.parquet"))
    stream = triage.read_table(spark, str(path), rows.schema, files=2)
    out = str(tmp_path / "out")
    triage.write_batches(stream, out, str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(out).drop("batch")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
