"""Holdouts, capped samples and picks by drawn order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from .windows import ordinal


def holdout(rows: DataFrame, group: str, count: int | None = None, fraction: float | None = None, within: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Adds ``held_out``: whole groups, a count or a fraction (at least one).

    within: columns inside which the groups are counted, such as a task.  Groups
    are numbered by ranges of the drawn order, not in one task.
    """
    within = within or []
    groups = rows.select(*within, group).distinct().withColumn("_h", draw(seed, group, "holdout"))
    placed = ordinal(groups, *within, "_h", group, name="_at")
    size = F.lit(count) if count is not None else F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(fraction)).cast("int"))
    limits = placed.groupBy(*within).agg((F.min("_at") + size).alias("_end"))
    ranked = placed.join(limits, within) if within else placed.join(F.broadcast(limits))
    return rows.join(ranked.select(*within, group, (F.col("_at") < F.col("_end")).alias("held_out")), [*within, group])


def require_disjoint(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """One row with the number of shared keys; fails when run unless it is 0."""
    shared = train.select(key).intersect(held_out.select(key)).agg(F.count("*").alias("shared"))
    return shared.select("shared", F.assert_true(F.col("shared") == 0, F.lit("train and held-out keys overlap")).alias("checked"))


def capped_sample(rows: DataFrame, group: str, identity: str, n: int, cap: int, seed: int = 0) -> DataFrame:
    """n rows in drawn order, at most cap of a group while others are left.

    The first cap rows of a group are found with a limit on each side of the
    shuffle; the others matter only as far as n rows of them can be needed.
    """
    hashed = rows.withColumn("_h", draw(seed, identity, "sample"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_h", identity))
    within = hashed.withColumn("_n", place).filter(F.col("_n") <= cap).drop("_n")
    rest = hashed.join(within.select(identity), identity, "left_anti").orderBy("_h", identity).limit(n)
    both = within.withColumn("_over", F.lit(0)).unionByName(rest.withColumn("_over", F.lit(1)))
    return both.orderBy("_over", "_h", identity).limit(n).drop("_h", "_over")


def uniform_sample(rows: DataFrame, identity: str, n: int, seed: int = 0) -> DataFrame:
    return rows.orderBy(draw(seed, identity, "sample"), identity).limit(n)


def first_of_each(rows: DataFrame, group: list[str | Column], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each group by an order."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n")


def shared_picks(rows: DataFrame, task: str, identity: str, default: int, sizes: dict[str, int] | None = None, seeds: dict[str, int] | None = None, seed: int = 0) -> DataFrame:
    """Picks per task in drawn order, with sizes and seeds for single tasks."""
    size, order = F.lit(default), draw(seed, identity, "pick")
    for name, n in (sizes or {}).items():
        size = F.when(F.col(task) == name, n).otherwise(size)
    for name, own in (seeds or {}).items():
        order = F.when(F.col(task) == name, draw(own, identity, "pick")).otherwise(order)
    most = max([default, *(sizes or {}).values()])
    place = F.row_number().over(Window.partitionBy(task).orderBy(order, identity))
    first = rows.withColumn("_n", place).filter(F.col("_n") <= most)  # a constant bound limits groups before the shuffle
    return first.filter(F.col("_n") <= size).drop("_n")


def extra_picks(rows: DataFrame, picked: DataFrame, task: str, identity: str, n: int, seed: int = 1) -> DataFrame:
    """More picks from what is left, by another stream: earlier ones stay."""
    return shared_picks(rows.join(picked.select(identity), identity, "left_anti"), task, identity, n, seed=seed)


def stride_batch(rows: DataFrame, order: list[str], offset: int, step: int, variants: list[str]) -> DataFrame:
    """Every step-th row from offset on, cycling through variants."""
    picked = ordinal(rows, *order, name="_at").filter(F.pmod(F.col("_at") - offset, F.lit(step)) == 0).filter(F.col("_at") >= offset)
    slot = ((F.col("_at") - offset) / step).cast("int")
    return picked.withColumn("variant", F.array(*[F.lit(v) for v in variants])[slot % len(variants)]).drop("_at")


def drawn_order(rows: DataFrame, identity: str, seed: int = 0) -> DataFrame:
    return rows.orderBy(draw(seed, identity, "shuffle"), identity)


def chunk_plan(spark, samples: int, chunk: int = 500, seed: int = 0) -> DataFrame:
    """chunk, seed, samples: bounded pieces of one generation run."""
    chunks = -(-samples // chunk)
    return spark.range(chunks).select(
        F.col("id").cast("int").alias("chunk"), (F.lit(seed) * 100_000 + F.col("id")).alias("seed"), F.least(F.lit(chunk), F.lit(samples) - F.col("id") * chunk).cast("int").alias("samples")
    )
