import subprocess
import sys
from pathlib import Path

import pytest

from parley import session

ROOT = str(Path(__file__).resolve().parent.parent)

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from parley.session import shared_dir, stage
builder = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
spark = builder.config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
assert shared_dir(spark) == sys.argv[2], shared_dir(spark)
staged = stage(spark.range(10).where("id > 3"))
assert staged.count() == 6
assert all(f.startswith("file://" + sys.argv[2]) for f in staged.inputFiles())
"""


def test_shared_folder_comes_from_the_session(tmp_path):
    folder = str(tmp_path / "shared")
    subprocess.run([sys.executable, "-c", SCRIPT, ROOT, folder], check=True, timeout=120)


def test_stage_keeps_rows_and_an_empty_table(spark):
    from parley.session import stage

    rows = spark.range(5).selectExpr("id", "array(id) as a", "struct(id as b) as s")
    assert sorted(stage(rows).collect()) == sorted(rows.collect())
    empty = stage(rows.where("id < 0"))
    assert empty.count() == 0 and empty.columns == rows.columns


def test_staged_copies_are_released(spark):
    kept = session.stage(spark.range(5))
    assert kept.count() == 5
    assert session.release(spark) >= 1
    assert session.release(spark) == 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        kept.count()
