"""Interval matching and hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from .windows import ordinal


def match_intervals(transitions: DataFrame, segments: DataFrame, begin: str, end: str, width: int | None = None) -> DataFrame:
    """Each transition with its most overlapping segment; those without go.

    transitions: clip_id, sample_id, [begin, end]; segments: clip_id, segment_id,
    start_frame, stop_frame, text.  Among equal overlaps the segment that comes
    first by (start_frame, segment_id) wins.  width: frames of a bucket; a clip
    with very many segments is then joined bucket by bucket.
    """
    left, right, keys = transitions, segments, ["clip_id"]
    if width:
        left = left.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))))
        right = right.filter("stop_frame >= start_frame").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_frame") / width), F.floor(F.col("stop_frame") / width))))
        keys = ["clip_id", "_bucket"]
    overlap = F.least(F.col(end), F.col("stop_frame")) - F.greatest(F.col(begin), F.col("start_frame"))
    best = F.max_by(F.struct("text", "segment_id"), F.struct(F.col("_overlap"), -F.col("start_frame"), -F.col("segment_id"))).alias("_best")
    found = left.join(right, keys).withColumn("_overlap", overlap).filter("_overlap > 0").groupBy("clip_id", "sample_id").agg(best)
    return transitions.join(found, ["clip_id", "sample_id"]).select(*transitions.columns, F.col("_best.text").alias("action_text"), F.col("_best.segment_id").alias("segment_id"))


def hard_negatives(transitions: DataFrame, clip: str = "clip_id", order: str = "current") -> DataFrame:
    """Two nearest and the farthest other targets of the same clip.

    Adds near, mid and far (target_native of each); transitions with fewer than
    three distinct other targets go.  Distances are between grid indices (a native
    frame of a clip has one); ties go to the earlier transition.  Targets stand in order of time, so the nearest
    are among the two before and after, and the farthest among the three at
    either end: window functions do it in linear time, without a self join.
    """
    first_of = Window.partitionBy(clip, "target_native").orderBy(order)
    targets = transitions.select(clip, order, "target_grid", "target_native").withColumn("_n", F.row_number().over(first_of)).filter("_n = 1")
    line = Window.partitionBy(clip).orderBy("target_grid", order)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = Window.partitionBy(clip).orderBy(F.desc("target_grid"), F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(F.col("target_grid").alias("grid"), F.col(order).alias("place"), F.col("target_native").alias("native"))
    rows = targets.withColumn("_own", own).withColumns(
        {
            "_close": F.array(*[F.lag("_own", k).over(line) for k in (2, 1)], *[F.lead("_own", k).over(line) for k in (1, 2)]),
            "_ends": F.array(*[F.nth_value("_own", k).over(whole) for k in (1, 2, 3)], *[F.nth_value("_own", k).over(back) for k in (1, 2, 3)]),
            "_count": F.count("*").over(Window.partitionBy(clip)),
        }
    )

    def ranked(column: str, sign: int):
        near = F.transform(
            F.filter(column, lambda s: s.isNotNull() & (s["native"] != F.col("target_native"))),
            lambda s: F.struct((sign * F.abs(s["grid"] - F.col("target_grid"))).alias("d"), s["place"].alias("place"), s["native"].alias("native")),
        )
        return F.array_sort(near)

    rows = rows.filter("_count >= 4").withColumn("_near", ranked("_close", 1)).withColumn("_far", ranked("_ends", -1))
    rows = rows.withColumns({"near": F.col("_near")[0]["native"], "mid": F.col("_near")[1]["native"]})
    far = F.filter("_far", lambda s: (s["native"] != F.col("near")) & (s["native"] != F.col("mid")))[0]["native"]
    picked = rows.select(F.col(clip), "target_native", "near", "mid", far.alias("far"))
    return transitions.join(picked, [clip, "target_native"])


def shuffled_options(rows: DataFrame, identity: str, truth: str, others: list[tuple[str, str]], seed: int = 0) -> DataFrame:
    """Adds candidates, candidate_types and answer_index in a drawn order.

    others: (column, type) of the wrong candidates.
    """
    listed = F.array(*[F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(identity).cast("string"), F.col(c).cast("string"))).alias("h"), F.col(c).alias("value"), F.lit(kind).alias("kind")) for c, kind in [(truth, "ground_truth"), *others]])
    out = rows.withColumn("_options", F.array_sort(listed))
    out = out.withColumns({"candidates": F.col("_options.value"), "candidate_types": F.col("_options.kind")}).drop("_options")
    return out.withColumn("answer_index", (F.array_position("candidate_types", F.lit("ground_truth")) - 1).cast("int"))


def _listed(asked: DataFrame, placed: DataFrame, identity: str) -> DataFrame:
    """(_asker, others) from the places that each row asks for, in order."""
    found = asked.join(placed.select("_at", F.col(identity).alias("_other")), "_at")
    return found.groupBy("_asker").agg(F.transform(F.array_sort(F.collect_list(F.struct("_step", "_other"))), lambda s: s["_other"]).alias("others"))


def ring_neighbours(rows: DataFrame, group: list[str], identity: str, k: int = 3, seed: int = 0) -> DataFrame:
    """k other rows of the same group, as an array: neighbours on a drawn ring.

    Distinct and never the row itself; groups of k rows or fewer go.  Rows are
    numbered by ranges and neighbours joined by number, so that a group of any
    size is spread over all tasks.
    """
    placed = ordinal(rows.select(*group, identity, draw(seed, identity, "ring").alias("_h")), *group, "_h", identity, name="_at")
    blocks = placed.groupBy(*group).agg(F.min("_at").alias("_start"), F.count("*").alias("_size")).filter(F.col("_size") > k)
    asked = placed.join(blocks, group).withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    want = F.col("_start") + (F.col("_at") - F.col("_start") + F.col("_step")) % F.col("_size")
    lists = _listed(asked.select(F.col(identity).alias("_asker"), "_step", want.alias("_at")), placed, identity)
    return rows.join(lists, rows[identity] == lists["_asker"]).drop("_asker")


def other_clip_negatives(rows: DataFrame, clip: str, identity: str, k: int = 3, seed: int = 0) -> DataFrame:
    """k rows of other clips: those behind the own clip's block on the ring.

    Adds ``others``; null where fewer than k rows belong to other clips.
    """
    hashed = rows.select(clip, identity, draw(seed, clip, "clip").alias("_c"), draw(seed, identity, "row").alias("_h"))
    placed = ordinal(hashed, "_c", clip, "_h", identity, name="_at")
    blocks = placed.groupBy(clip).agg(F.max("_at").alias("_end"), F.count("*").alias("_block"))
    total = placed.agg(F.count("*").alias("_n"))  # one row
    asked = placed.join(blocks, clip).join(F.broadcast(total))
    asked = asked.filter(F.col("_n") - F.col("_block") >= k).withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    want = F.pmod(F.col("_end") + F.col("_step"), F.col("_n"))
    lists = _listed(asked.select(F.col(identity).alias("_asker"), "_step", want.alias("_at")), placed, identity)
    return rows.join(lists, rows[identity] == lists["_asker"], "left").drop("_asker")


def negatives_with_fallback(transitions: DataFrame, cross: bool = True, seed: int = 0) -> DataFrame:
    """Negatives of the same clip, else of other clips, else none (the row goes)."""
    own = hard_negatives(transitions).withColumn("negatives", F.array("near", "mid", "far")).withColumn("negative_kind", F.lit("same_clip")).drop("near", "mid", "far")
    if not cross:
        return own
    rest = transitions.join(own.select("sample_id"), "sample_id", "left_anti")
    pool = other_clip_negatives(transitions, "clip_id", "sample_id", 3, seed).select("sample_id", "others")
    natives = transitions.select(F.col("sample_id").alias("_other"), F.col("target_native").alias("_native"))
    wanted = rest.join(pool.filter("others is not null"), "sample_id").select("sample_id", F.posexplode("others").alias("_step", "_other"))
    lists = wanted.join(natives, "_other").groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_step", "_native"))), lambda s: s["_native"]).alias("negatives"))
    crossed = rest.join(lists, "sample_id").withColumn("negative_kind", F.lit("other_clip"))
    return own.unionByName(crossed.select(*own.columns))
