"""Parameter tables of synthetic samples, drawn row by row from md5.

Rendering isn't part of this library; the tables feed a renderer.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import between, draw
from .sets import distinct_by
from .windows import ordinal

# -- fixed values ----------------------------------------------------------
ROTATION_SHAPES = ("L_shape", "T_shape", "trapezoid", "arrow")
ANALOGY_SHAPES = (
    "square", "triangle", "circle", "diamond", "pentagon", "hexagon", "rectangle", "oval", "star", "heart",
    "cross", "arrow", "trapezoid", "rhombus", "octagon", "crescent", "plus", "minus", "L_shape", "T_shape",
)
MOVES = {"center": 0, "up": -60, "down": 60, "up_small": -40, "down_small": 40, "up_large": -80, "down_large": 80, "up_tiny": -25, "down_tiny": 25, "up_huge": -100, "down_huge": 100}
ANALOGY_COLOURS = 400
SKIPPED_KEYS = (
    "temp_path", "temp_dir", "temp_file", "video_temp_path", "image_temp_path", "cache_path", "cache_dir",
    "_cache", "_internal", "_temp", "_tmp", "seed", "random_seed", "tmp", "tmpdir",
)


def task_ids(spark: SparkSession, domain: str, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("sample"), F.format_string(f"{domain}_%08d", "id").alias("task_id"))


def rotation_parameters(spark: SparkSession, n: int, seed: int = 0, distinct: bool = True) -> DataFrame:
    """Shape, centre, angle 30-330, direction, initial angle and colour."""
    rows = task_ids(spark, "rotation", n)
    pick = lambda name, low, high: between(seed, "task_id", name, low, high)
    rows = rows.select(
        "sample",
        "task_id",
        F.array(*[F.lit(s) for s in ROTATION_SHAPES])[pick("shape", 0, len(ROTATION_SHAPES) - 1)].alias("shape"),
        pick("x", 150, 362).alias("x"),
        pick("y", 150, 362).alias("y"),
        pick("angle", 30, 330).alias("angle"),
        F.when(pick("direction", 0, 1) == 0, "clockwise").otherwise("counterclockwise").alias("direction"),
        pick("initial", 0, 359).alias("initial"),
        F.array(*[pick(f"colour{i}", 50, 200) for i in range(3)]).alias("colour"),
    )
    signature = F.concat_ws("|", "shape", "direction", F.bround(F.col("angle") / 5).cast("string"), F.bround(F.col("initial") / 5).cast("string"), F.bround(F.col("x") / 5).cast("string"), F.bround(F.col("y") / 5).cast("string"))
    return distinct_by(rows, signature, "sample") if distinct else rows


def puzzle_parameters(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Four cells of which as many as the difficulty says are turned."""
    rows = task_ids(spark, "puzzle", n).withColumn("turned", between(seed, "task_id", "difficulty", 1, 4))
    order = F.array_sort(F.array(*[F.struct(draw(seed, "task_id", f"cell{i}").alias("h"), F.lit(i).alias("cell")) for i in range(4)]))
    rows = rows.withColumn("_order", F.transform(order, lambda s: s["cell"]))
    angles = F.array(*[F.when(F.array_position("_order", F.lit(i)) <= F.col("turned"), between(seed, "task_id", f"angle{i}", 1, 359)).otherwise(0) for i in range(4)])
    return rows.withColumn("angles", angles).drop("_order")


def analogy_parameters(spark: SparkSession, n: int, shapes: tuple[str, ...] = ANALOGY_SHAPES, colours: int = ANALOGY_COLOURS, seed: int = 0) -> DataFrame:
    """n distinct combinations of two shapes, two colours and two moves, each pair different.

    Combinations are drawn one by one, and a repeated one goes; twice as many
    are drawn as asked for.  More than a quarter of all combinations is refused.
    """
    moves = tuple(MOVES)
    sizes = {"shape": len(shapes), "colour": colours, "move": len(moves)}
    every = 1
    for size in sizes.values():
        every *= size * (size - 1)
    if 4 * n > every:
        raise ValueError(f"{n} of {every} combinations can't be drawn apart")
    rows = spark.range(2 * n + 64).select("id")
    pick = lambda name, high: between(seed, "id", name, 0, high)
    for name, size in sizes.items():  # the second differs from the first
        rows = rows.withColumn(f"{name}_1", pick(f"{name}_1", size - 1))
        rows = rows.withColumn(f"{name}_2", (F.col(f"{name}_1") + 1 + pick(f"{name}_2", size - 2)) % size)
    key = F.concat_ws(":", *[f"{name}_{k}" for name in sizes for k in (1, 2)])
    first = ordinal(distinct_by(rows, key, "id"), "id", name="place").filter(F.col("place") < n)
    named = lambda values, column: F.array(*[F.lit(v) for v in values])[F.col(column)]
    return first.select(
        "place",
        named(shapes, "shape_1").alias("shape"),
        named(shapes, "shape_2").alias("second_shape"),
        F.col("colour_1").alias("colour_from"),
        F.col("colour_2").alias("colour_to"),
        named(moves, "move_1").alias("move_from"),
        named(moves, "move_2").alias("move_to"),
        named(tuple(MOVES.values()), "move_2").alias("move_pixels"),
    )


def _layouts(seed: int, size: int, gap: float, tries: int):
    import hashlib

    def place(task: str) -> list[dict]:
        roll = lambda name, low, high: low + int(hashlib.md5(f"{seed}:{task}:{name}".encode()).hexdigest()[:8], 16) % (high - low + 1)
        want, items = roll("count", 2, 5), []
        for attempt in range(tries):
            if len(items) == want:
                break
            radius = roll(f"size{attempt}", 18, 34)
            x, y = (roll(f"{axis}{attempt}", radius, size - radius) for axis in "xy")
            if all(((x - o["x"]) ** 2 + (y - o["y"]) ** 2) ** 0.5 >= (radius + o["size"]) * 2**0.5 + gap for o in items):
                items.append({"idx": len(items), "x": float(x), "y": float(y), "size": float(radius)})
        return items

    def run(batches):
        for rows in batches:
            out = [{"layout": t, **item} for t in rows.task_id for item in place(t)]
            yield pd.DataFrame(out, columns=["layout", "idx", "x", "y", "size"])

    return run


def placement_layouts(spark: SparkSession, n: int, seed: int = 0, size: int = 512, gap: float = 10.0, tries: int = 400) -> DataFrame:
    """Objects placed one after the other where they collide with none (rejection)."""
    return task_ids(spark, "placement", n).select("task_id").mapInPandas(_layouts(seed, size, gap, tries), "layout string, idx int, x double, y double, size double").withColumn("shape", F.lit("square"))


def canonical(parameters: str | None) -> str | None:
    """JSON with sorted keys and floats at six places; on the top level, keys that
    name something temporary and null values are left out."""

    def plain(value):
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items()}
        if isinstance(value, list):
            return [plain(v) for v in value]
        return round(value, 6) if isinstance(value, float) else value

    if parameters is None:
        return None
    kept = {k: plain(v) for k, v in json.loads(parameters).items() if v is not None and not any(word in k.lower() for word in SKIPPED_KEYS)}
    return json.dumps(kept, sort_keys=True, ensure_ascii=False)


def with_parameter_hash(rows: DataFrame, parameters: str = "parameters") -> DataFrame:
    """Adds the canonical parameters and the first 16 hex digits of their sha256."""
    normal = F.pandas_udf(lambda s: s.map(canonical), "string")
    return rows.withColumn("canonical", normal(F.col(parameters))).withColumn("param_hash", F.substring(F.sha2("canonical", 256), 1, 16))


def complete_metadata(metadata: str | Column) -> Column:
    """Whether a metadata record (JSON text) has all it must have: its fields, a
    hash of 16 characters, parameters that are an object, and under generation a
    seed and the commit."""
    parsed = F.try_parse_json(F.col(metadata) if isinstance(metadata, str) else metadata)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    there = lambda path: F.try_variant_get(parsed, path, "variant").isNotNull()
    out = kind("$.parameters").startswith("OBJECT") & (F.length(F.try_variant_get(parsed, "$.param_hash", "string")) == 16)
    for path in ("$.task_id", "$.generator", "$.timestamp", "$.generation.seed", "$.generation.git.commit"):
        out = out & there(path)
    return F.coalesce(out, F.lit(False))


def without_credentials(url: Column) -> Column:
    """A remote address as host and path: user names and tokens go."""
    return F.regexp_replace(F.regexp_replace(url, r"\A(\w+://)[^/@]*@", "$1"), r"\.git\z", "")
