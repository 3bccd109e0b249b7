"""Scalar scoring rules and group statistics as Column builders.

Everything is safe under ANSI mode: a ratio without a denominator is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- fixed values ----------------------------------------------------------
LEVELS = {"wrong": 0.0, "partial": 0.5, "correct": 1.0}
YES, NO = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
SAME_COLOUR = 25.0
LIGHTNESS = 0.5


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def band(value: Column, good: Column | float, bad: Column | float) -> Column:
    """1 up to good, 0 from bad on, linear between."""
    good, bad = (x if isinstance(x, Column) else F.lit(float(x)) for x in (good, bad))
    return F.when(value <= good, 1.0).when(value >= bad, 0.0).otherwise(1.0 - F.try_divide(value - good, bad - good))


def blankness_ceiling(foreground: Column, reference: Column) -> Column:
    ratio = foreground / F.greatest(F.lit(1.0), reference)
    return F.when(ratio < 0.05, 0.0).when(ratio < 0.15, 0.25).when(ratio < 0.30, 0.6).otherwise(1.0)


def coverage_gate(drawn: Column, reference: Column, low: float = 0.15, high: float = 0.6, floor: float = 0.1, least: int = 20) -> Column:
    """Only under-drawing counts, and only against a reference that has a path."""
    coverage = F.when(reference < least, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(drawn.cast("double"), reference.cast("double"))))
    return F.when(coverage >= high, 1.0).when(coverage <= low, floor).otherwise(floor + (coverage - low) / (high - low) * (1 - floor))


def off_palette_penalty(share: Column, start: float, stop: float, floor: float) -> Column:
    return F.when(share <= start, 1.0).when(share >= stop, floor).otherwise(1.0 - (share - start) / (stop - start) * (1 - floor))


def lab_distance(a: Column, b: Column) -> Column:
    """Distance of Lab structs (l, a, b) with lightness weighed down."""
    return F.sqrt(F.pow((a["l"] - b["l"]) * LIGHTNESS, 2) + F.pow(a["a"] - b["a"], 2) + F.pow(a["b"] - b["b"], 2))


def centroid_distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def axial_difference(a: Column, b: Column) -> Column:
    """Angle between undirected axes in degrees, 0 to 90."""
    d = F.abs(F.pmod(a - b, F.lit(180.0)))  # no negative zero
    return F.least(d, 180.0 - d)


def signed_angle(a: Column) -> Column:
    """Degrees in (-180, 180]: a half turn is positive."""
    return 180.0 - F.pmod(180.0 - a, F.lit(360.0))


def agreement(rule: Column, judge: Column) -> Column:
    gap = judge - rule
    return F.when(gap >= 0.5, "judge much higher").when(F.abs(gap) >= 0.5, "judge much lower").when(F.abs(gap) >= 0.25, "disagreement").otherwise("close agreement")


def json_block(response: Column) -> Column:
    """From the first opening brace to the last closing one; null if none."""
    return F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit(""))


def balanced_json(response: Column) -> Column:
    """The first balanced object, by the running depth of braces; else null."""
    marks = F.split(F.translate(response, "\u0001", " "), "")
    state = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("last")),
        lambda s, c: F.struct(
            F.when(s["last"] > 0, s["depth"]).when(c == "{", s["depth"] + 1).when((c == "}") & (s["first"] > 0), s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            (s["at"] + 1).alias("at"),
            F.when((s["first"] == 0) & (c == "{"), s["at"] + 1).otherwise(s["first"]).alias("first"),
            F.when((s["last"] == 0) & (c == "}") & (s["first"] > 0) & (s["depth"] == 1), s["at"] + 1).otherwise(s["last"]).alias("last"),
        ),
    )
    return F.when(state["last"] > 0, F.substring(response, state["first"], state["last"] - state["first"] + 1))


def truthy(value: Column) -> Column:
    """true, false, or null where the value is neither."""
    value = F.lower(F.trim(value.cast("string")))
    return F.when(value.isin(*YES), True).when(value.isin(*NO), False)


def _level_value(level: Column) -> Column:
    level = F.lower(F.trim(level))
    out = F.lit(None).cast("double")
    for name, value in LEVELS.items():
        out = F.when(level == name, value).otherwise(out)
    return out


def rubric_score(levels: Column, weights: dict[str, float]) -> Column:
    """Weighted mean of level values in 0..1; 0.0 if a level is missing or unknown.

    A level is a bare string, or an object (as JSON text) of observation and
    level.  A judgement that cannot be read counts as zero, it isn't left out.
    """
    total = sum(weights.values())
    level_value = lambda v: _level_value(F.when(v.rlike(r"^\s*\{"), F.coalesce(F.get_json_object(v, "$.level"), F.lit(""))).otherwise(v))
    parts = [level_value(F.try_element_at(levels, F.lit(k))) * (w / total) for k, w in weights.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    unknown = F.exists(F.map_values(levels), lambda v: level_value(v).isNull())
    return F.coalesce(F.when(~unknown, clamp(out)), F.lit(0.0))


def yes_share(answers: Column, keys: list[str]) -> Column:
    """Share of yes; null (left out of means) if an answer is missing or unclear."""
    votes = [truthy(F.try_element_at(answers, F.lit(k))).cast("int") for k in keys]
    out = votes[0]
    for v in votes[1:]:
        out = out + v
    return out / F.lit(float(len(keys)))


def percent_score(value: Column) -> Column:
    return clamp(value / 100.0)


def overall(parts: Column, weights: dict[str, float]) -> Column:
    """Sum of sub-scores by weight."""
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + F.try_element_at(parts, F.lit(k)) * w
    return out


def pearson(x: str, y: str) -> Column:
    """Correlation of a group as an aggregate; null without variance.

    Constants are told by their extremes: a variance merged from partitions may
    be slightly above 0 for them.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    flat = (F.max(a) - F.min(a) == 0.0) | (F.max(b) - F.min(b) == 0.0)
    spread = F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when(~flat, F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0))))


def average_rank(value: str, *groups: str) -> Column:
    """Rank from 1, equal values sharing the mean of theirs; null has none."""
    own = Window.partitionBy(*groups, F.col(value).isNull()).orderBy(value)
    ties = Window.partitionBy(*groups, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(own) + (F.count("*").over(ties) - 1) / 2)


def spearman(rows: DataFrame, groups: list[str], x: str, y: str, name: str = "spearman") -> DataFrame:
    """Rank correlation per group over rows that have both values."""
    usable = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = usable.withColumns({"_rx": average_rank(x, *groups), "_ry": average_rank(y, *groups)})
    return ranked.groupBy(*groups).agg(pearson("_rx", "_ry").alias(name))
