"""Aggregates over score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def summary(records: DataFrame, task: str = "task_name", score: str = "score") -> DataFrame:
    """Per task and over all rows (task null): n counts every record, the mean
    only scored ones; a task without a score has a null mean."""
    return records.rollup(task).agg(F.count("*").alias("n"), F.count(score).alias("n_scored"), F.avg(score).alias("mean_score"), F.min(score).alias("min_score"), F.max(score).alias("max_score")).withColumn(
        "is_total", F.col(task).isNull()
    )


def model_means(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Means of rule and judge over rows that have both; 0 for an empty group."""
    both = F.col("rule_score").isNotNull() & F.col("judge_score").isNotNull()
    return scores.groupBy(*keys).agg(
        F.count_if(both).alias("n"), F.coalesce(F.avg(F.when(both, F.col("rule_score"))), F.lit(0.0)).alias("mean_rule"), F.coalesce(F.avg(F.when(both, F.col("judge_score"))), F.lit(0.0)).alias("mean_judge")
    )


def subset_means(scores: DataFrame, keys: list[str], third: str) -> DataFrame:
    """The same on the rows that a third judge scored as well; null if none."""
    own = F.col(third).isNotNull()
    return scores.groupBy(*keys).agg(F.count_if(own).alias("n_subset"), F.avg(F.when(own, F.col("rule_score"))).alias("rule_subset"), F.avg(F.when(own, F.col("judge_score"))).alias("judge_subset"), F.avg(third).alias("third_subset"))


def weighted_domain_mean(tasks: DataFrame, domain: str) -> DataFrame:
    """Means weighted by n; a task without a mean counts as 0 with its full n."""
    return tasks.groupBy(domain).agg(F.try_divide(F.sum(F.coalesce("mean_score", F.lit(0.0)) * F.col("n")), F.sum("n")).alias("weighted_mean"))


def distribution(records: DataFrame, keys: list[str], score: str) -> DataFrame:
    return records.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.min(score).alias("low"), F.max(score).alias("high"), F.count_if(F.col(score) < 0.5).alias("below_half"))


def level_counts(records: DataFrame, system: str, variant: str, score: str) -> DataFrame:
    """Distinct score levels of each system, and the spread of variant means."""
    means = records.groupBy(system, variant).agg(F.avg(score).alias("_mean"))
    spread = means.groupBy(system).agg((F.max("_mean") - F.min("_mean")).alias("spread"))
    levels = records.groupBy(system).agg(F.count_distinct(F.round(score, 4)).alias("levels"))
    return levels.join(spread, system)


def histogram(records: DataFrame, keys: list[str], score: str) -> DataFrame:
    return records.filter(F.col(score).isNotNull()).groupBy(*keys, F.round(score, 3).alias("value")).agg(F.count("*").alias("n"))


def no_counts(records: DataFrame, keys: list[str], answers: str) -> DataFrame:
    """How often each question of an answer map was answered with no."""
    return records.select(*keys, F.explode(answers).alias("question", "yes")).groupBy(*keys, "question").agg(F.count_if(~F.col("yes")).alias("n_no"), F.count("yes").alias("n_answers"))


def discrimination(records: DataFrame, keys: list[str], score: str, correct: str, reference: str | None = None) -> DataFrame:
    """Means of correct and mismatched pairs and their gap; exact-match rate."""
    good, bad = F.avg(F.when(F.col(correct), F.col(score))), F.avg(F.when(~F.col(correct), F.col(score)))
    out: list[Column] = [good.alias("mean_correct"), bad.alias("mean_wrong"), (good - bad).alias("gap")]
    if reference:
        out.append(F.avg((F.abs(F.col(score) - F.col(reference)) < 1e-6).cast("double")).alias("exact_rate"))
    return records.groupBy(*keys).agg(*out)


def sampling_stats(clips: DataFrame, windows: DataFrame, keys: list[str], target: int) -> DataFrame:
    """Clips available, eligible and too short; windows, spacings, shortfall."""
    per_clip = windows.groupBy(*keys, "clip_id").agg(F.count("*").alias("_w"), F.first("delta_s").alias("_d"))
    joined = clips.join(per_clip, [*keys, "clip_id"], "left")
    total = F.coalesce(F.sum("_w"), F.lit(0))
    return joined.groupBy(*keys).agg(
        F.count("*").alias("available"),
        F.count("_w").alias("eligible"),
        F.count_if(F.col("_w").isNull()).alias("too_short"),
        total.alias("n_windows"),
        F.array_sort(F.collect_set("_d")).alias("spacings"),
        (total < target).alias("shortfall"),
    )


def gap_stats(scores: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """Rule against judge: mean gap, large gaps, zeros, the worst overrating."""
    gap = F.col("judge_score") - F.col("rule_score")
    return scores.groupBy(*keys).agg(
        F.avg(F.abs(gap)).alias("mean_gap"),
        F.count_if(F.abs(gap) >= 0.5).alias("n_large"),
        F.count_if(F.col("rule_score") == 0).alias("n_zero"),
        F.count_if(F.col("rule_score") > 0).alias("n_positive"),
        F.min_by(identity, F.struct(gap, F.col(identity))).alias("worst"),
    )


def worst_and_typical(records: DataFrame, keys: list[str], identity: str, score: str) -> DataFrame:
    """The lowest record and the one nearest the mean, unless it is the same."""
    means = records.groupBy(*keys).agg(F.avg(score).alias("_mean"), F.min_by(identity, F.struct(score, identity)).alias("worst"))
    near = records.join(means, keys).groupBy(*keys).agg(F.first("worst").alias("worst"), F.min_by(identity, F.struct(F.abs(F.col(score) - F.col("_mean")), F.col(identity))).alias("typical"))
    return near.withColumn("typical", F.when(F.col("typical") != F.col("worst"), F.col("typical")))


def mean_gap(scores: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"))


def needed_frames(windows: DataFrame, clip: str, *frames: str) -> DataFrame:
    """The distinct frames that a set of windows needs."""
    types = dict(windows.dtypes)
    listed = F.concat(*[F.col(c) if types[c].startswith("array") else F.array(F.col(c)) for c in frames])
    return windows.select(clip, F.explode(listed).alias("frame")).distinct()


def with_first(records: DataFrame, task: str, order: str, *columns: str) -> DataFrame:
    """Per task the columns of its first record (its category, its domain)."""
    return records.groupBy(task).agg(*[F.min_by(c, order).alias(c) for c in columns])


def distinct_groups(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """How many different source groups the rows of each key use; nulls don't count."""
    return rows.groupBy(*keys).agg(F.count_distinct(group).alias("n_groups"))


def ranked_tasks(tasks: DataFrame, domain: str, task: str, mean: str) -> DataFrame:
    """Place of each task in its domain, the highest mean first; no mean counts as 0."""
    place = F.row_number().over(Window.partitionBy(domain).orderBy(F.desc(F.coalesce(F.col(mean), F.lit(0.0))), task))
    return tasks.withColumn("place", place)
