"""Writers: JSON lines, dataset descriptions, id lists, safe rewrites."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, where: str, text: str) -> None:
    """A small file through the file system that Spark uses."""
    path, system = _path(spark, where)
    stream = system.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def json_lines(rows: DataFrame, where: str) -> int:
    """One object a line, null fields left out; returns the number of rows,
    which is counted while writing."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(where)
    return seen.get["n"]


def sorted_keys(rows: DataFrame) -> DataFrame:
    """Fields in alphabetical order on every level of structs."""

    def order(column, kind):
        if isinstance(kind, T.StructType):
            fields = sorted(kind.fields, key=lambda f: f.name)
            return F.when(column.isNotNull(), F.struct(*[order(column[f.name], f.dataType).alias(f.name) for f in fields]))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(column, lambda x: order(x, kind.elementType))
        return column

    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    return rows.select(*[order(F.col(f.name), f.dataType).alias(f.name) for f in fields])


def dataset(rows: DataFrame, where: str, key: str, root: str = "/", patches: int = 3, task_type: str = "imgen") -> dict:
    """Rows and their description, whose length is that of the rows written."""
    n = json_lines(rows, f"{where}/rows")
    meta = {key: {"root": root, "annotation": f"{where}/rows", "data_augment": False, "max_dynamic_patch": patches, "repeat_time": 1, "length": n, "task_type": task_type}}
    write_text(rows.sparkSession, f"{where}/meta.json", json.dumps(meta, indent=2))
    return meta


def id_list(rows: DataFrame, key: str, where: str) -> None:
    rows.select(F.col(key).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(where)


def summary(spark: SparkSession, rows: DataFrame, where: str, limit: int = 10_000) -> None:
    """A small aggregate as one JSON file; more than ``limit`` rows are an error."""
    found = rows.limit(limit + 1).toJSON().collect()
    if len(found) > limit:
        raise ValueError(f"a summary of more than {limit} rows belongs in a table")
    write_text(spark, where, json.dumps([json.loads(x) for x in found], indent=2, ensure_ascii=False))


def rewrite(rows: DataFrame, where: str) -> str:
    """Replace a folder by rows that may be read from it; returns the backup.

    The new rows are written beside it, then both folders change names.
    """
    spark = rows.sparkSession
    mark = uuid.uuid4().hex[:8]
    new, old = f"{where}.new-{mark}", f"{where}.bak-{mark}"
    json_lines(rows, new)
    target, system = _path(spark, where)
    if system.exists(target):
        system.rename(target, _path(spark, old)[0])
    system.rename(_path(spark, new)[0], target)
    return old


def output_names(stem: str, bare: bool = False, direction: str = "forward", captions: bool = True) -> str:
    """A name for each mode, so that none overwrites another."""
    return stem + "_no_ce" * bare + f"_{direction}" * (direction != "forward") + "_nocap" * (not captions)
