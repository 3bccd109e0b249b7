"""Lookup, label, filter and ledger joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import latest


class MissingKeys(ValueError):
    """A lookup that must match found rows without a match."""


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], ordinal: str | None = None, missing: str = "raise", fallback: dict[str, Column] | None = None) -> DataFrame:
    """Rows with the columns of a table whose last entry of a key wins.

    missing: "raise" (an error that names five keys), "skip", "keep" (nulls) or
    "fallback" (columns from ``fallback``).  Keys may be arrays.
    """
    build = latest(table, keys, ordinal).drop(ordinal) if ordinal else table
    if missing == "raise":
        gone = rows.join(build, keys, "left_anti").select(*keys).limit(5).collect()
        if gone:
            raise MissingKeys(f"no entry for keys such as {[tuple(r) for r in gone]}")
    if missing in ("raise", "skip"):
        return rows.join(build, keys)
    out = rows.join(build, keys, "left")
    for name, value in (fallback or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), value))
    return out


def split_by_label(rows: DataFrame, labels: DataFrame, key: str, ok: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a usable label, ledger of the keys of the others)."""
    joined = rows.join(latest(labels, [key], ordinal).drop(ordinal), key, "left")
    usable = F.coalesce(F.col(ok), F.lit(False))
    return joined.filter(usable), joined.filter(~usable).select(key)


def downloaded(rows: DataFrame, status: str = "status", path: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Rows whose download is marked a success and, if a listing is given, whose
    file is in it.  A null status is no success."""
    done = rows.filter(F.col(status) == "success")
    return done if existing is None else done.join(existing.select(F.col("path").alias(path)), path, "left_semi")


def drop_missing_paths(rows: DataFrame, identity: str, paths: list[str], existing: DataFrame) -> DataFrame:
    """Rows all of whose paths exist (null paths are fine).

    paths: columns, arrays or single; existing: one column ``path``.
    """
    types = dict(rows.dtypes)
    listed = F.concat(*[F.coalesce(F.col(p), F.array().cast("array<string>")) if types[p].startswith("array") else F.array(F.col(p)) for p in paths])
    named = rows.select(identity, F.explode(listed).alias("path")).filter("path is not null")
    bad = named.join(existing.select("path"), "path", "left_anti").select(identity).distinct()
    return rows.join(bad, identity, "left_anti")


def drop_counts(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Kept and dropped rows of each source."""
    counted = before.groupBy(by).agg(F.count("*").alias("n_before")).join(after.groupBy(by).agg(F.count("*").alias("n_after")), by, "left")
    kept = F.coalesce("n_after", F.lit(0))
    return counted.select(by, kept.alias("n_kept"), (F.col("n_before") - kept).alias("n_dropped"))


def fresh_candidates(rows: DataFrame, key: str, *ledgers: DataFrame) -> DataFrame:
    """Rows that no ledger (succeeded, failed, ...) has."""
    seen = ledgers[0].select(key)
    for more in ledgers[1:]:
        seen = seen.union(more.select(key))
    return rows.join(seen, key, "left_anti")


def to_resume(rows: DataFrame, done: DataFrame, key: str, score: str) -> DataFrame:
    """Rows not yet scored; a record without a score is tried again."""
    return rows.join(done.filter(F.col(score).isNotNull()).select(key), key, "left_anti")


def in_every_system(scores: DataFrame, key: list[str], system: str, systems: int) -> DataFrame:
    """Keys that each of so many systems has scored."""
    return scores.filter("score is not null").groupBy(*key).agg(F.count_distinct(system).alias("_n")).filter(F.col("_n") == systems).drop("_n")


def combine_scores(rules: DataFrame, judges: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Rule score, judge score and description of what all three have."""
    return rules.filter("rule_score is not null").join(judges.filter("judge_score is not null"), keys).join(meta, keys)


def judge_by_task(rubric: DataFrame, yes_no: DataFrame, task: str, yes_no_tasks: list[str]) -> DataFrame:
    """The yes/no judge for some tasks, the rubric judge for the others."""
    return rubric.filter(~F.col(task).isin(yes_no_tasks)).unionByName(yes_no.filter(F.col(task).isin(yes_no_tasks)), allowMissingColumns=True)


def shifted_pairs(rows: DataFrame, group: str, order: str, shift: int) -> DataFrame:
    """Each row with the one ``shift`` places on, cyclically: mismatched pairs."""
    from pyspark.sql import Window

    line = Window.partitionBy(group).orderBy(order)
    placed = rows.withColumn("_i", F.row_number().over(line) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    other = placed.select(F.col(group), F.col("_i").alias("_j"), F.col(order).alias("other"))
    return placed.withColumn("_j", (F.col("_i") + shift) % F.col("_n")).join(other, [group, "_j"]).drop("_i", "_j", "_n")
