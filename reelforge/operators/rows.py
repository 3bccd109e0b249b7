"""Training rows of every setting, from anchors.

An anchor has example_id, context_paths, candidate_paths, answer_index and, by
source, action_text or caption.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions.draws import coin


def conversation(human: Column, answer: Column) -> Column:
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return F.array(turn("human", human), turn("gpt", answer))


def direction(choice: str, identity: str, seed: int = 0) -> Column:
    """forward, backward, or a drawn one of both for "mixed"."""
    if choice == "mixed":
        return F.when(coin(seed, identity, "direction"), "backward").otherwise("forward")
    if choice not in ("forward", "backward"):
        raise ValueError(f"unknown direction {choice!r}")
    return F.lit(choice)


def re_point(context: Column, target: Column, backward: Column) -> tuple[Column, Column, Column]:
    """(context, target, condition): the same frames read in either direction."""
    turned = F.concat(F.slice(context, 2, F.size(context)), F.array(target))
    return F.when(backward, turned).otherwise(context), F.when(backward, context[0]).otherwise(target), F.when(backward, context[1]).otherwise(F.element_at(context, -1))


def generation_rows(anchors: DataFrame, choice: str = "mixed", scene: str = "a real-world video", caption: str | None = None, flag: bool | None = None, setting: str | None = None, seed: int = 0) -> DataFrame:
    """Next-frame rows.  flag: has_caption by decree; else if there is a text."""
    way = direction(choice, "example_id", seed)
    rows = anchors.withColumns({"direction": way, "_target": F.col("candidate_paths")[F.col("answer_index")]})
    backward = F.col("direction") == "backward"
    image, target, condition = re_point(F.col("context_paths"), F.col("_target"), backward)
    described = F.col(caption) if caption else None
    n = F.size("context_paths")
    human = P.generation_prompt(n, backward, scene, described)
    has = F.lit(flag) if flag is not None else (F.coalesce(described, F.lit("")) != "" if caption else F.lit(False))
    return rows.select(
        "example_id",
        F.lit("imgen").alias("task_type"),
        "direction",
        has.alias("has_caption"),
        image.alias("image"),
        target.alias("target_image"),
        condition.alias("cond_image"),
        conversation(human, P.generation_answer(backward)).alias("conversations"),
        F.lit(setting).cast("string").alias("setting"),
    )


def action_rows(anchors: DataFrame, scene: str = "an egocentric kitchen video", with_action: bool = True, camera: bool = False) -> DataFrame:
    n, action = F.size("context_paths"), F.col("action_text") if with_action else None
    human = P.camera_prompt(n, action) if camera else P.action_prompt(n, action, scene)
    return anchors.select("example_id", F.lit("imgen").alias("task_type"), F.col("context_paths").alias("image"), F.col("candidate_paths")[F.col("answer_index")].alias("target_image"), conversation(human, F.lit(P.ANSWER_NEXT)).alias("conversations"))


def edit_rows(anchors: DataFrame) -> DataFrame:
    """The same target from the last context frame alone."""
    return anchors.select("example_id", F.lit("imgen").alias("task_type"), F.array(F.element_at("context_paths", -1)).alias("image"), F.col("candidate_paths")[F.col("answer_index")].alias("target_image"), conversation(P.edit_prompt(F.col("action_text")), F.lit(P.ANSWER_EDIT)).alias("conversations"))


def selection_rows(anchors: DataFrame, scene: str = "first-person camera frames from an egocentric kitchen video, in order", with_action: bool = False) -> DataFrame:
    human = P.selection_prompt(F.size("context_paths"), F.size("candidate_paths"), scene, F.col("action_text") if with_action else None)
    return anchors.select("example_id", F.lit("understanding").alias("task_type"), F.concat("context_paths", "candidate_paths").alias("image"), conversation(human, P.letter(F.col("answer_index"))).alias("conversations"))


def dual_rows(selection: DataFrame, context: int = 3, setting: str | None = "S3", held_out: bool = False, separate: bool = True) -> DataFrame:
    """Selection rows that are also generated: the chosen option is the target.

    separate: fail if the condition frame is among the options, which would give
    the answer away; windows that share frames may need False.
    """
    options = F.slice("image", context + 1, F.size("image"))
    answer = F.ascii(F.element_at("conversations", 2)["value"]) - 65
    condition = F.col("image")[context - 1]
    rows = selection.withColumns({"_options": options, "target_image": options[answer], "cond_image": condition})
    checked = F.when(F.lit(separate) & F.array_contains("_options", F.col("cond_image")), F.raise_error(F.lit("the condition frame is an option"))).otherwise(F.col("cond_image"))
    flags = F.concat(F.array_repeat(F.lit(0), context), F.array_repeat(F.lit(1), F.size("_options")))
    return rows.withColumns({"cond_image": checked, "is_option": flags, "task_type": F.lit("imgen"), "imgen_form": F.lit("multimodal"), "setting": F.lit(setting).cast("string"), "eval_holdout": F.lit(held_out)}).drop("_options")


def progression_skeleton(rows: DataFrame, prefix: str = "caption_prefix") -> DataFrame:
    """Rows with the describe-then-predict prompt; the answer comes later."""
    return rows.withColumn("conversations", conversation(P.progression_prompt(F.size("image"), F.col(prefix)), F.lit("")))


def labelling_manifest(rows: DataFrame, prefix: str = "caption_prefix") -> DataFrame:
    return rows.select("id", "source", F.col("image").alias("context_paths"), "target_image", prefix, P.labelling_prompt(F.size("image"), F.col(prefix)).alias("vlm_prompt"), F.concat("image", F.array("target_image")).alias("vlm_images"))


def with_answers(rows: DataFrame, progression: str, following: str) -> DataFrame:
    human = F.element_at("conversations", 1)["value"]
    return rows.withColumn("conversations", conversation(human, P.answer_turn(F.col(progression), F.col(following))))


def row_id(key: str, number: Column, digits: int = 6) -> Column:
    return F.format_string(f"{key}_%0{digits}d", number.cast("long"))


def without_image_block(prompt: Column) -> Column:
    return F.when(prompt.startswith("<image>\n"), F.substring(prompt, 9, 1 << 30)).otherwise(prompt)


def sound_answers(anchors: DataFrame) -> DataFrame:
    """Anchors whose marked answer isn't the ground truth; there must be none."""
    return anchors.filter(F.col("candidate_types")[F.col("answer_index")] != "ground_truth")
