"""Session settings, and the one place where intermediate tables are written."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # JSON objects may repeat a key; the last one counts.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    # Per-file outputs are written without sorting a task's rows by file first.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}

_local_scratch: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings that the transforms rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    # Python workers then need no copy of this package on their path.
    cloudpickle.register_pickle_by_value(sys.modules["markscale"])
    return spark


INPUT_TASKS = "spark.markscale.inputTasks"


def deal(df: DataFrame) -> DataFrame:
    """Deal rows over the number of tasks that the session names in ``spark.markscale.inputTasks``.

    Worth its shuffle where an input of one row group would keep a single core busy. Without the
    setting the rows stay as they are scanned.
    """
    tasks = df.sparkSession.conf.get(INPUT_TASKS, None)
    return df.repartition(int(tasks)) if tasks else df


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that the session names for checkpoints."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = _local_root(spark)
    return f"{root.rstrip('/')}/markscale/{label}-{uuid.uuid4().hex}"


def _local_root(spark: SparkSession) -> str:
    global _local_scratch
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="markscale-")
    return _local_scratch


def release(spark: SparkSession, path: str) -> None:
    """Free a written intermediate table: an empty one takes its place."""
    spark.range(0).write.mode("overwrite").parquet(path)


def materialise(
    df: DataFrame, label: str, path: str | None = None, partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Write ``df`` as a table once and return a reader of the written copy.

    Whatever is read from it afterwards, a lost executor costs a re-read and never a second
    run of the plan (or of the model calls) behind it.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, label)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    return spark.read.schema(df.schema).parquet(target)
