"""The folder that the driver and all executors share, and tables staged there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, deleted when the driver ends.

    Without that setting only a local master gets one: executors on other
    machines couldn't read a folder of this one.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="reelforge-")
        context.setCheckpointDir(root)
    where = f"{root.rstrip('/')}/reelforge/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, where)
    return where


def _delete(spark: SparkSession, where: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read again: the same for every later use."""
    where = shared_folder(rows.sparkSession, name)
    rows.write.parquet(where)
    return rows.sparkSession.read.schema(rows.schema).parquet(where)
