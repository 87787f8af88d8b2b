"""Session settings and the shared folder that outlives any one executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "parley", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session, where all executors are this machine, may fall back to a
    temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="parley-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_STAGED: list[str] = []


def stage(df: DataFrame, passing: list[str] | None = None) -> DataFrame:
    """Write an intermediate that several branches read, so it is computed once.

    The copy is a Parquet table in the shared folder: lost executors do not lose it, readers
    prune its columns, and the planner knows its size. :func:`release` removes the copies, those
    listed in ``passing`` on their own, once nothing is read from them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    if passing is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, passing: list[str] | None = None) -> int:
    """Remove the staged copies of this program, once its results are written, or those listed."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    staged = _STAGED if passing is None else passing
    removed = 0
    while staged:
        path = files.Path(staged.pop())
        removed += path.getFileSystem(settings).delete(path, True)
    return removed
