"""Ordered unions, renumbering, intersections and systematic complements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import latest, ordinal


def merge_sources(sources: dict[str, DataFrame], row_order: str, key: str) -> DataFrame:
    """All rows in the order of the sources, renumbered as key_000000.

    Columns that a source lacks are null; the former id, of whatever type,
    becomes the string ``orig_id``.
    """
    tagged = [df.withColumns({"source": F.lit(name), "_source": F.lit(i)}) for i, (name, df) in enumerate(sources.items())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return merge_tagged(rows, "_source", row_order, key).drop("_source")


def merge_tagged(rows: DataFrame, source_order: str | Column, row_order: str, key: str) -> DataFrame:
    """The same for rows of one table that tell their source: read once,
    whatever the number of sources."""
    former = rows.withColumn("orig_id", F.col("id").cast("string")).drop("id")
    return renumber(former, source_order, row_order, key=key)


def renumber(rows: DataFrame, *order: str | Column, key: str) -> DataFrame:
    """Ids key_000000, key_000001, ... in an order."""
    return ordinal(rows, *order, name="_at").withColumn("id", F.format_string(f"{key}_%06d", F.col("_at"))).drop("_at")


def merge_shards(shards: list[DataFrame], key: str, position: str) -> DataFrame:
    """Union of label shards; the last shard's last row of a key wins."""
    rows = reduce(lambda a, b: a.unionByName(b), [s.withColumn("_shard", F.lit(i)) for i, s in enumerate(shards)])
    rows = rows.withColumn("_order", F.struct("_shard", position))
    return latest(rows, [key], "_order").drop("_order", "_shard")


def distinct_by(rows: DataFrame, signature: str | Column, order: str) -> DataFrame:
    """The first row of each signature."""
    signature = F.col(signature) if isinstance(signature, str) else signature
    from pyspark.sql import Window

    line = Window.partitionBy("_signature").orderBy(order)
    return rows.withColumn("_signature", signature).withColumn("_n", F.row_number().over(line)).filter("_n = 1").drop("_n", "_signature")


def unused_combinations(used: DataFrame, *values: DataFrame) -> DataFrame:
    """Combinations of bounded value lists that no row uses, in order."""
    every = reduce(lambda a, b: a.crossJoin(b), values)
    return every.join(used.select(*every.columns), every.columns, "left_anti").orderBy(*every.columns)


def quantised(values: Column, step: float = 5.0) -> Column:
    """Numbers rounded to a grid and sorted, as a signature."""
    return F.array_join(F.array_sort(F.transform(values, lambda v: (F.bround(v / step) * step).cast("long"))).cast("array<string>"), ",")


def names_only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct names of ``a`` that ``b`` lacks."""
    return a.select(key).subtract(b.select(key))
