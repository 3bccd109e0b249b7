"""The test tables read as clips, frames, anchors and score records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import mining, windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a native frame of its user's clip, in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), (F.row_number().over(order) - 1).alias("frame"), "event_id", "event_type", "value")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    out = events.groupBy(F.col("user_id").alias("clip_id")).agg(F.count("*").cast("int").alias("num_frames"))
    out = out.withColumn("fps", (F.col("clip_id") % 30 + 1).cast("double"))
    return out.withColumn("duration_sec", F.col("num_frames") / F.col("fps"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.grid_windows(clips(spark, sf_dir))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth frame begins an interval of eight frames."""
    rows = frames(spark, sf_dir).filter("frame % 5 = 0")
    return rows.select("clip_id", F.col("frame").alias("start_frame"), (F.col("frame") + 7).alias("stop_frame"), F.col("event_type").alias("text"), F.col("event_id").alias("segment_id"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions with drawn options, as paths."""
    rows = mining.hard_negatives(transitions(spark, sf_dir))
    rows = mining.shuffled_options(rows, "sample_id", "target_native", [("near", "near_wrong_state"), ("mid", "mid_wrong_state"), ("far", "same_video_distractor")])
    path = lambda c: F.transform(c, lambda i: F.concat_ws("/", F.lit("frames"), F.col("clip_id").cast("string"), F.concat(i.cast("string"), F.lit(".jpg"))))
    return rows.withColumns({"example_id": F.concat(F.lit("selection:"), F.col("sample_id")), "context_paths": path("context_native"), "candidate_paths": path("candidates"), "action_text": F.concat(F.lit("step "), F.col("current").cast("string"))})


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and judge records: id, run, task, domain and two partial scores."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rule = F.when(F.col("doc_id") % 11 != 0, (F.col("n_chars") % 101) / 100.0)
    judge = (F.col("quality") * 3 + F.col("toxic") + F.col("doc_id") % 5) / 8.0
    out = docs.join(labels, "doc_id", "left")
    return out.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("run"),
        F.col("source").alias("task_name"),
        F.when(F.col("lang") == "en", "ID").otherwise("OOD").alias("domain"),
        rule.alias("rule_score"),
        judge.alias("judge_score"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector gives an image with three objects of each role."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"), "embedding")
    part = lambda j: F.get("embedding", F.col("k") * 6 + j).cast("double")
    lab = F.struct((part(0) * 100 + 128).alias("l"), (part(1) * 100 + 128).alias("a"), (part(2) * 100 + 128).alias("b"))
    role = F.array(F.lit("input"), F.lit("cand"), F.lit("gt"))[F.col("k") % 3]
    return rows.select(
        F.col("vec_id").cast("string").alias("image_id"),
        role.alias("role"),
        F.floor(F.col("k") / 3).cast("int").alias("idx"),
        (part(3) * 500 + 256).alias("x"),
        (part(4) * 500 + 256).alias("y"),
        (F.abs(part(5)) * 5000 + 100).alias("area"),
        lab.alias("lab"),
        F.when(part(0) > 0, "square").otherwise("circle").alias("shape"),
    )


