"""Frame windows over clips, and ordered-window helpers.

A clip is (clip_id, num_frames, fps).  Its frame grid takes every
``native_stride``-th native frame.  Strides round half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged


def with_grid(clips: DataFrame, sample_fps: float) -> DataFrame:
    """Adds native_stride and n_grid."""
    stride = F.greatest(F.lit(1), F.bround(F.col("fps") / sample_fps).cast("int"))
    return clips.withColumn("native_stride", stride).withColumn("n_grid", F.floor((F.col("num_frames") - 1) / F.col("native_stride")).cast("int") + 1)


def long_enough(clips: DataFrame, context: int, horizon: int) -> DataFrame:
    """Clips whose duration holds one window."""
    return clips.filter(F.col("duration_sec") >= (context - 1 + horizon) / F.col("fps"))


def eligible(clips: DataFrame, moves: DataFrame) -> DataFrame:
    """Clips that have at least one window."""
    return clips.join(moves.select("clip_id"), "clip_id", "left_semi")


def grid_windows(clips: DataFrame, context: int = 3, horizon: int = 2, stride: int = 2, sample_fps: float = 2.0, anchor: str = "last") -> DataFrame:
    """One row for each window of a clip: context frames, then a target.

    anchor: "last" numbers a window by its last context frame, "start" by its
    first.  Columns: clip_id, sample_id, current, context_grid, context_native,
    target_grid, target_native.  A clip without room gives no row.
    """
    grid = with_grid(clips, sample_fps)
    first = context - 1 if anchor == "last" else 0
    last = F.col("n_grid") - 1 - horizon if anchor == "last" else F.col("n_grid") - (context + horizon)
    rows = grid.filter(last >= first).withColumn("current", F.explode(F.sequence(F.lit(first), last, F.lit(stride))))
    start = F.col("current") - first
    rows = rows.withColumn("context_grid", F.transform(F.sequence(F.lit(0), F.lit(context - 1)), lambda i: start + i))
    rows = rows.withColumn("target_grid", start + context - 1 + horizon)
    rows = rows.withColumns({"context_native": F.transform("context_grid", lambda g: g * F.col("native_stride")), "target_native": F.col("target_grid") * F.col("native_stride")})
    rows = rows.filter((F.col("target_native") < F.col("num_frames")) & (F.element_at("context_native", -1) < F.col("num_frames")))
    sample = F.concat_ws(":", F.col("clip_id").cast("string"), F.col("current").cast("string"), F.col("target_grid").cast("string"))
    return rows.select("clip_id", sample.alias("sample_id"), "current", "context_grid", "context_native", "target_grid", "target_native")


def adaptive_delta(clips: DataFrame, tiers: tuple[float, ...] = (1.0, 0.75, 0.5)) -> DataFrame:
    """Adds delta_s and delta_frames: the widest spacing a clip has room for.

    Short clips start at a narrower tier; null if no tier fits.
    """
    duration = F.col("num_frames") / F.col("fps")
    start = F.when(duration < 3.0, 0.5).when(duration < 4.0, 0.75).otherwise(1.0)
    frames = {t: F.greatest(F.lit(1), F.bround(F.col("fps") * t).cast("int")) for t in tiers}
    delta = F.lit(None).cast("double")
    for t in sorted(tiers):
        delta = F.when((F.lit(t) <= start) & (F.col("num_frames") - 1 >= 3 * frames[t]), t).otherwise(delta)
    out = clips.withColumn("delta_s", delta)
    count = F.lit(None).cast("int")
    for t in tiers:
        count = F.when(F.col("delta_s") == t, frames[t]).otherwise(count)
    return out.withColumn("delta_frames", count)


def adaptive_windows(clips: DataFrame, cap: int = 7, tiers: tuple[float, ...] = (1.0, 0.75, 0.5)) -> DataFrame:
    """Four evenly spaced frames for each window, the first ``cap`` of a clip."""
    fit = adaptive_delta(clips.filter((F.col("num_frames") >= 4) & (F.col("fps") > 0)), tiers).filter("delta_s is not null")
    starts = F.slice(F.sequence(F.lit(0), F.col("num_frames") - 1 - 3 * F.col("delta_frames"), F.greatest(F.lit(1), 2 * F.col("delta_frames"))), 1, cap)
    rows = fit.select("*", F.posexplode(starts).alias("ordinal", "start"))
    frames = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("start") + i * F.col("delta_frames"))
    rows = rows.withColumn("frame_indices", frames)
    return rows.withColumn("frame_times_s", F.transform("frame_indices", lambda i: F.bround(i / F.col("fps"), 3)))


def latest(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of each key by ordinal."""
    order = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def ordinal(rows: DataFrame, *order: str | Column, name: str = "id") -> DataFrame:
    """Numbers all rows from 0 in an order without one task for all rows.

    Rows are dealt by ranges of the order; a row's number is its place in its
    range plus the sizes of the ranges before, which are few.  The dealt rows are
    written to the shared folder, since both uses must see the same ranges, also
    after an executor is lost.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    place = Window.partitionBy("_part").orderBy(*order)
    placed = staged(dealt.withColumn("_place", F.row_number().over(place)), "ordinal")
    sizes = placed.groupBy("_part").agg(F.max("_place").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_part", "_place", "_before")


def has_diagonal_move(points: DataFrame, group: str, order: str) -> DataFrame:
    """Per group whether two consecutive points differ in both coordinates."""
    by = Window.partitionBy(group).orderBy(order)
    steps = points.withColumns({"_dx": F.col("x") - F.lag("x").over(by), "_dy": F.col("y") - F.lag("y").over(by)})
    return steps.groupBy(group).agg(F.coalesce(F.bool_or((F.col("_dx") != 0) & (F.col("_dy") != 0)), F.lit(False)).alias("diagonal"))


def context_lists(frames: DataFrame, clip: str, order: list[str], value: str, size: int = 3) -> DataFrame:
    """The last ``size`` values up to each row, where there are as many."""
    by = Window.partitionBy(clip).orderBy(*order)
    rows = frames.withColumn("context", F.collect_list(value).over(by.rowsBetween(1 - size, 0)))
    return rows.filter(F.size("context") == size)
