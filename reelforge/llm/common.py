"""Shared plumbing: shared scratch folder, staging, word rules, batch sizes.

Stages are written as Parquet below ``spark.checkpoint.dir`` (the folder that
all executors share) and read again.  That cuts lineage, survives the loss of
any executor and gives the optimiser true sizes, so that it broadcasts a side
only when its measured size is below the threshold.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch.  Texts may be long, so a batch holds few of them.
ARROW_ROWS = 1000
#: Bytes after which a batch ends, whatever its rows.
ARROW_BYTES = 16 << 20
#: The word rule of every operator here, as a Java / RE2 / Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches (two settings of the session) and make sure that a shared folder is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    scratch_root(spark)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only on a single machine.

    Executors on other machines couldn't read a folder of this one, so without
    ``spark.checkpoint.dir`` only a local master gets one.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="reelforge-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Parquet stages of one query below the shared folder.

    ``put`` writes a frame and reads it again; ``drop`` deletes a stage as soon
    as nothing reads it.  What the returned frame still reads is deleted when
    the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/reelforge/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop, self.root)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def put(self, df: DataFrame) -> DataFrame:
        where = self.path()
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out.stage_path = where
        return out

    def drop(self, what: str | DataFrame) -> None:
        where = what if isinstance(what, str) else what.stage_path
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(where)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception as gone:  # the session may have ended before this runs at exit
            if self.spark.sparkContext._jsc is not None:
                raise gone


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that columns of ``df`` bear."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: str = "text") -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64(F.col(text))


def blocks_of(bytes_: str | bytes | None) -> list[bytes]:
    """The words of a text: bytes.split() cuts at exactly 0x20 and 0x09-0x0D."""
    if bytes_ is None:
        return []
    return (bytes_.encode() if isinstance(bytes_, str) else bytes_).split()
