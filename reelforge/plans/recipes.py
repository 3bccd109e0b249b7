"""Whole recipes: from clips to merged settings, and described progressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import scenes
from ..operators import joins, mining, rows, sets, splits, windows

# -- fixed values ----------------------------------------------------------
CLOSING_FORWARD = (
    "You are shown 3 consecutive frames sampled evenly in time from this sequence. Based on the direction and rate of motion or transformation "
    "established across these 3 frames, predict the very next frame: advance everything that is moving or changing by one more equal "
    "increment along the same established direction. Do not jump ahead to the final, completed, or goal state -- show only one more "
    "incremental step of continued motion."
)
CLOSING_BACKWARD = (
    "You are shown 3 consecutive frames sampled evenly in time from this sequence, occurring immediately AFTER the frame you must predict. "
    "Based on the direction and rate of motion or transformation established across these 3 frames, predict the frame that occurred "
    "immediately BEFORE the first frame shown: reverse one equal increment of the same established motion. Do not jump back to the very "
    "start or initial state -- show only one step backward in time from the first frame shown."
)
PRESETS: dict[str, list[str]] = {"pilot5": ["multi_object_placement", "shape_color_then_move", "shape_outline_then_move", "rotation_puzzle", "2d_geometric_transformation"]}


@dataclass(frozen=True)
class SourceConfig:
    """Window and sample settings of one video source."""

    name: str
    context: int = 3
    horizon: int = 2
    stride: int = 2
    sample_fps: float = 2.0
    anchor: str = "last"
    cross_clip: bool = False
    target: int = 7000
    cap: int = 20
    seed: int = 0


def resolve_tasks(explicit: list[str] | None, preset: str | None, valid: list[str], default: list[str]) -> list[str]:
    """Tasks given outright, or those of a preset that are valid here, or the default."""
    if explicit and preset:
        raise ValueError("give tasks or a preset, not both")
    if explicit:
        return list(explicit)
    if not preset:
        return default
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; known: {sorted(PRESETS)}")
    usable = [t for t in PRESETS[preset] if t in set(valid)]
    if not usable:
        raise ValueError(f"no task of preset {preset!r} is valid here")
    return usable


def usable_pool(pool: DataFrame) -> DataFrame:
    """Judged clips that show a kitchen, hands at work, and were found desirable."""
    return pool.filter(F.col("kitchen") & F.col("manipulation") & (F.col("desirable_filtering") == "desirable"))


def anchors(clips: DataFrame, config: SourceConfig, segments: DataFrame | None = None, root: str = "frames") -> DataFrame:
    """Clips to anchors: windows, interval texts if any, negatives, drawn options,
    and a capped sample."""
    moves = windows.grid_windows(clips, config.context, config.horizon, config.stride, config.sample_fps, config.anchor)
    if segments is not None:
        moves = mining.match_intervals(moves.withColumn("last_native", F.element_at("context_native", -1)), segments, "last_native", "target_native")
    found = mining.negatives_with_fallback(moves, config.cross_clip, config.seed)
    found = found.withColumns({f"_n{i}": F.col("negatives")[i] for i in range(3)})
    kinds = ("near_wrong_state", "mid_wrong_state", "same_video_distractor")
    found = mining.shuffled_options(found, "sample_id", "target_native", [(f"_n{i}", kinds[i]) for i in range(3)], config.seed)
    found = splits.capped_sample(found, "clip_id", "sample_id", config.target, config.cap, config.seed)
    path = lambda c: F.transform(c, lambda i: P.frame_path(root, F.col("clip_id"), i))
    found = found.withColumns({"example_id": P.text("selection:", F.col("sample_id")), "context_paths": path("context_native"), "candidate_paths": path("candidates")})
    return found.drop("_n0", "_n1", "_n2", "negatives", "candidates")


def synthetic_prompt(task: Column, parameters: Column, backward: Column, described: bool = True) -> Column:
    closing = F.when(backward, CLOSING_BACKWARD).otherwise(CLOSING_FORWARD)
    return P.text(scenes.scenes(task, parameters), "\n\n", closing) if described else closing


def synthetic_rows(samples: DataFrame, prefix: str = "syn", choice: str = "forward", described: bool = True, bare: bool = False, setting: str | None = None, seed: int = 0) -> DataFrame:
    """Rows of sampled windows (window_id, task_name, category, frames[4], raw_parameters).

    bare: the answer is the image mark alone.  Ids number the windows of a task.
    """
    place = F.row_number().over(Window.partitionBy("task_name").orderBy("window_id")) - 1
    found = samples.withColumns({"direction": rows.direction(choice, "window_id", seed), "_n": place})
    backward = F.col("direction") == "backward"
    image, target, condition = rows.re_point(F.slice("frames", 1, 3), F.col("frames")[3], backward)
    human = P.text("<image>\n" * 3, synthetic_prompt(F.col("task_name"), F.col("raw_parameters"), backward, described))
    answer = F.lit(P.ANSWER_BARE) if bare else P.generation_answer(backward)
    return found.select(
        P.text(f"{prefix}_", F.col("task_name"), "_", F.format_string("%05d", F.col("_n").cast("long"))).alias("id"),
        F.lit("imgen").alias("task_type"),
        "task_name",
        "category",
        F.lit("ID").alias("split"),
        "direction",
        F.lit(described).alias("has_caption"),
        image.alias("image"),
        target.alias("target_image"),
        condition.alias("cond_image"),
        F.lit(bare).alias("no_ce"),
        rows.conversation(human, answer).alias("conversations"),
        F.lit(setting).cast("string").alias("setting"),
    )


def synthetic_dual_rows(samples: DataFrame, prefix: str = "syn", held_out: int = 200, described: bool = True, seed: int = 0) -> DataFrame:
    """Multiple-choice rows whose wrong options are targets of other windows of the
    same task on the same side of the holdout."""
    sided = splits.holdout(samples, "window_id", count=held_out, within=["task_name"], seed=seed)
    ring = mining.ring_neighbours(sided, ["task_name", "held_out"], "window_id", 3, seed)
    targets = samples.select(F.col("window_id").alias("_w"), F.col("frames")[3].alias("_t"))
    for i in range(3):
        ring = ring.join(targets.withColumnsRenamed({"_w": f"_w{i}", "_t": f"_t{i}"}), F.col("others")[i] == F.col(f"_w{i}"))
    ring = ring.withColumn("target", F.col("frames")[3])
    ring = mining.shuffled_options(ring, "window_id", "target", [(f"_t{i}", "distractor") for i in range(3)], seed)
    side = F.when(F.col("held_out"), "eval").otherwise("train")
    place = F.row_number().over(Window.partitionBy("task_name", "held_out").orderBy("window_id")) - 1
    human = P.choice_prompt(scenes.scenes(F.col("task_name"), F.col("raw_parameters")) if described else None)
    found = ring.withColumns({"_n": place, "_cond": F.col("frames")[2]})
    condition = F.when(F.array_contains("candidates", F.col("_cond")), F.raise_error(F.lit("the condition frame is an option"))).otherwise(F.col("_cond"))
    return found.select(
        P.text(f"{prefix}_", F.col("task_name"), "_dual_", side, "_", F.format_string("%05d", F.col("_n").cast("long"))).alias("id"),
        F.lit("imgen").alias("task_type"),
        F.lit("multimodal").alias("imgen_form"),
        "task_name",
        "category",
        F.col("held_out").alias("eval_holdout"),
        F.lit("forward").alias("direction"),
        F.lit(described).alias("has_caption"),
        F.concat(F.slice("frames", 1, 3), "candidates").alias("image"),
        F.col("candidates")[F.col("answer_index")].alias("target_image"),
        condition.alias("cond_image"),
        F.concat(F.array_repeat(F.lit(0), 3), F.array_repeat(F.lit(1), 4)).alias("is_option"),
        rows.conversation(human, P.letter(F.col("answer_index"))).alias("conversations"),
        F.lit("S3").alias("setting"),
    )


def merged_setting(sources: dict[str, DataFrame], existing: DataFrame, key: str, row_order: str = "_row") -> DataFrame:
    """Sources merged in order, rows with a missing image dropped, renumbered."""
    return existing_only(sets.merge_sources(sources, row_order, key), existing, key)


def existing_only(merged: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Merged rows whose images all exist, numbered anew in their order."""
    kept = joins.drop_missing_paths(merged, "id", [c for c in ("image", "target_image", "cond_image") if c in merged.columns], existing)
    return sets.renumber(kept.withColumnRenamed("id", "_merged"), F.length("_merged"), "_merged", key=key).drop("_merged")


def caption_prefixes(setting: DataFrame, source: str, manifest: DataFrame, extract: Callable[[DataFrame], Column], ordinal: str | None = None) -> DataFrame:
    """id, context_paths, caption_prefix for the rows of one source.

    A row's images are looked up among the manifest's context paths, where the
    last entry wins; ``extract`` builds the prefix from the manifest.  A row
    without an entry is an error.
    """
    wanted = setting.filter(F.col("source") == source).select("id", F.col("image").alias("context_paths"))
    table = manifest.select("context_paths", extract(manifest).alias("caption_prefix"), *([ordinal] if ordinal else []))
    return joins.lookup(wanted, table, ["context_paths"], ordinal)


def progression_inputs(setting: DataFrame, prefixes: DataFrame, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(skeleton rows, labelling manifest); fails if a row has no caption prefix.

    prefixes: context_paths, caption_prefix; the last one of a key wins.
    """
    table = prefixes.withColumnRenamed("context_paths", "image")
    found = joins.lookup(setting, table, ["image"], ordinal)
    skeleton = rows.progression_skeleton(found).drop("caption_prefix").withColumn("setting", F.lit("S4"))
    return skeleton, rows.labelling_manifest(found)


def filled_progressions(skeleton: DataFrame, labels: DataFrame, key: str, order: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(finished rows renumbered, ledger of dropped ids) from labelled responses.

    The former id stays as ``orig_id``; rows whose label can't be read go.
    """
    first, second = P.labelled_parts(F.col("raw"))
    read = labels.withColumns({"progression": first, "next_frame_text": second}).withColumn("parsed_ok", F.col("progression").isNotNull())
    kept, dropped = joins.split_by_label(skeleton, read.select("id", "progression", "next_frame_text", "parsed_ok", ordinal), "id", "parsed_ok", ordinal)
    done = rows.with_answers(kept, "progression", "next_frame_text").drop("progression", "next_frame_text", "parsed_ok")
    return sets.renumber(done.withColumn("orig_id", F.col("id")), order, key=key), dropped


def provenance(config: SourceConfig, train: int, held_out: int, setting: str) -> str:
    """A text that says how a data set was made."""
    seconds = config.horizon / config.sample_fps
    return (
        f"version: 1\ntask: next-frame generation, setting={setting}\nsource: {config.name}\n"
        f"sample_fps: {config.sample_fps}, context_size: {config.context}, horizon: {config.horizon} grid-steps ({seconds:.2f}s), "
        f"stride: {config.stride} grid-steps ({config.stride / config.sample_fps:.2f}s)\nsplit: {train} train, {held_out} eval\nseed: {config.seed}\n"
    )


def split_scan(ids: DataFrame, variants: list[str], scored: DataFrame) -> DataFrame:
    """A record for each sample and variant; what wasn't scored has no score."""
    every = ids.select("id", "task_name", F.explode(F.array(*[F.lit(v) for v in variants])).alias("run"))
    return every.join(scored.select("id", "run", "score"), ["id", "run"], "left")
