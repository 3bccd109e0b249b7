"""Readers with explicit schemas, and listings of media trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One object a line; blank lines are skipped.  strict: malformed lines fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def json_lines_with_place(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines with their file; ``malformed`` holds a line that isn't JSON."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).filter(F.trim("value") != "")
    clean = F.regexp_replace("value", "\\A\ufeff", "")
    parsed = lines.withColumn("row", F.from_json(clean, schema))
    bad = F.col("row").isNull() | F.try_parse_json(clean).isNull()
    return parsed.select("file", "row.*", F.when(bad, F.col("value")).alias("malformed"))


def tagged(frame: DataFrame, source: str) -> DataFrame:
    return frame.withColumn("source", F.lit(source))


def json_map(spark: SparkSession, path: str, value_schema: str, key: str) -> DataFrame:
    """A file with one object keyed by id, as a row for each id."""
    whole = spark.read.text(path, wholetext=True)
    mapped = F.from_json("value", T.MapType(T.StringType(), T.StructType.fromDDL(value_schema)))
    return whole.select(F.explode(mapped).alias(key, "_v")).select(key, "_v.*")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; strings are trimmed."""
    rows = spark.read.csv(path, header=True, schema=schema)
    return rows.select(*[F.trim(c).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes])


def id_list(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """A text file of ids, trimmed, without blank lines or a byte order mark."""
    value = F.trim(F.regexp_replace("value", "\\A\ufeff", ""))
    return spark.read.text(path).select(value.alias(name)).filter(F.col(name) != "")


def sidecars(spark: SparkSession, pattern: str, schema: str, name: str = "id") -> DataFrame:
    """JSON files of one object each; the id is the file's stem."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern)
    return rows.withColumn(name, F.regexp_extract("_metadata.file_path", r"([^/]+)\.json\z", 1))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths of the files below a folder that aren't empty; the contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def complete_folders(paths: DataFrame, required: list[str]) -> DataFrame:
    """Folders that hold all of the required file names."""
    parts = paths.select(F.regexp_extract("path", r"\A(.*)/[^/]+\z", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"))
    have = parts.filter(F.col("name").isin(required)).groupBy("folder").agg(F.count_distinct("name").alias("n"))
    return have.filter(F.col("n") == len(required)).select("folder")


def video_ids(paths: DataFrame, pattern: str = r"([^/]+)\.MP4\z") -> DataFrame:
    return paths.select(F.regexp_extract("path", pattern, 1).alias("video_id")).filter("video_id <> ''").distinct()


def images(spark: SparkSession, root: str) -> DataFrame:
    """path, height, width, data (BGR rows) of the images below a folder."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).load(root)
    return rows.select(F.regexp_replace("image.origin", "^file:/+", "/").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def join_systems(blobs: dict[str, DataFrame]) -> DataFrame:
    """Record lists of several runs as rows tagged with the run."""
    out = None
    for name, frame in blobs.items():
        rows = frame.select(F.lit(name).alias("run"), F.explode("records").alias("_r")).select("run", "_r.*")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


class Labeller(Protocol):
    """An external service: one answer for each request, None if it failed."""

    def __call__(self, prompt: str, images: list[str]) -> str | None: ...


def label(rows: DataFrame, connect: Callable[[], Labeller], prompt: str, images_: str, attempts: int = 3, threads: int = 4) -> DataFrame:
    """Adds response and error: a client for each task, a few calls at a time.

    A failed row is recorded after its last attempt and stops nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()

        def ask(request: tuple[str, list[str]]) -> tuple[str | None, str | None]:
            error = None
            for _ in range(attempts):
                try:
                    answer = client(*request)
                    if answer is not None:
                        return answer, None
                    error = "no answer"
                except Exception as e:  # a service may fail in any way; the row says how
                    error = str(e) or type(e).__name__
            return None, error

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                done = list(pool.map(ask, zip(batch[prompt], [list(x) for x in batch[images_]], strict=True)))
                yield batch.assign(response=[d[0] for d in done], error=[d[1] for d in done])

    schema = T.StructType([*rows.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])
    return rows.mapInPandas(run, schema)
