"""Resumable labelling over a stream of requests.

Each micro-batch drops what a ledger of finished keys already has, labels the
rest and appends to the ledger, so that a restart does nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.joins import fresh_candidates


def resumable(requests: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], ledger: str) -> DataStreamWriter:
    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
        done = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        fresh = rows.dropDuplicates([key])
        if done:
            fresh = fresh_candidates(fresh, key, spark.read.parquet(ledger))
        work(fresh).write.mode("append").parquet(ledger)

    return requests.writeStream.foreachBatch(batch)
