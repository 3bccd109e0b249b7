"""Prompt and answer texts as Column builders.

The wordings are fixed values: training rows must carry exactly these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values ----------------------------------------------------------
ANSWER_NEXT = "The next frame should look like this: <img>"
ANSWER_PREVIOUS = "The preceding frame should look like this: <img>"
ANSWER_EDIT = "Here is the edited frame after executing this camera action: <img>"
ANSWER_BARE = "<img>"
PREDICTION_MARK = "Next frame prediction:"
NUMBER_WORDS = {1: "one", 2: "two", 3: "three", 4: "four", 5: "five"}
NAMED_COLOURS = {
    "red": (255, 0, 0),
    "green": (0, 255, 0),
    "blue": (0, 0, 255),
    "yellow": (255, 255, 0),
    "magenta": (255, 0, 255),
    "cyan": (0, 255, 255),
    "orange": (255, 165, 0),
    "purple": (128, 0, 128),
    "pink": (255, 192, 203),
    "white": (255, 255, 255),
    "black": (0, 0, 0),
    "gray": (128, 128, 128),
    "brown": (139, 69, 19),
}
PROGRESSION = (
    "You are shown {count} consecutive frames, in temporal order. First, in 1-2 sentences (no more than about 40 words), "
    "describe how the scene changes across them, based only on what is visible in these {count} frames. Then, prefaced with "
    '"Next frame prediction:", predict in 1-2 sentences (no more than about 40 words) what the next frame will look like.'
)
LABELLING = (
    "You are given {total} images. Frames 1-{n} are consecutive frames from a video, in temporal order. Frame {total} is the true next "
    "frame. Context: {caption} First, in 1-2 sentences (no more than about 40 words), describe how the scene changes across Frames 1-{n}, "
    "in temporal order. Then, in 1-2 sentences (no more than about 40 words), describe what Frame {total} looks like. Write both as direct, "
    'factual descriptions -- no hedging language, no meta-commentary like "in this sequence". Return exactly two sentences-groups in this format:\n'
    "Progression: <your progression description>\n"
    "Next frame: <your description of frame {total}>"
)
MULTIPLE_CHOICE = (
    "You are shown 3 consecutive frames sampled evenly in time from this sequence, followed by {k} candidate next frames. Based on the "
    "direction and rate of motion or transformation established across the 3 context frames, identify which candidate is the true next frame.\n"
    "{options}\nWhich option is the true next frame? Answer with a single letter ({letters})."
)
NAVIGATION = "These are {count} consecutive first-person camera frames from an egocentric navigation video sequence."

KITCHEN_PREFIX = "These are {n} consecutive first-person camera frames from an egocentric kitchen video. Action being performed after the last frame: {action}"


# -- builders ----------------------------------------------------------------
def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def filled(template: str, **values: str | Column) -> Column:
    """A template with columns in its braces."""
    out: list[str | Column] = []
    for piece in template.split("{"):
        name, brace, rest = piece.partition("}")
        out += [values[name], rest] if brace else [piece]
    return text(*[o for o in out if not isinstance(o, str) or o])


def image_block(n: Column) -> Column:
    return F.repeat(F.lit("<image>\n"), n.cast("int"))


def numbered_frames(n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(F.lit("Frame "), i.cast("string"), F.lit(": <image>\n"))), "")


def letter(index: Column) -> Column:
    return F.char(index + 65)


def options(k: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: F.concat(F.lit("Option "), letter(i), F.lit(": <image>\n"))), "")


def letters(k: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), letter), ", ")


def number_word(n: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, n.cast("int")), n.cast("string"))


def with_period(value: Column) -> Column:
    value = F.trim(value)
    return F.when(value.rlike(r"[.!?]\z"), value).otherwise(F.concat(value, F.lit(".")))


def squeeze(value: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", " "), r"\A | \z", "")


def generation_prompt(n: Column, backward: Column, scene: str, caption: Column | None = None) -> Column:
    """The two directions of next-frame generation, with a description if given."""
    before = text("These are ", n, f" consecutive frames from {scene}")
    forward = text(before, ". Observe these frames and produce the next frame of the video.")
    back = text(
        before,
        ", occurring immediately AFTER the frame you must predict. Based on the direction and rate of motion established across them, "
        "predict the frame that occurred immediately BEFORE the first frame shown.",
    )
    closing = F.when(backward, back).otherwise(forward)
    if caption is None:
        return text(image_block(n), closing)
    described = F.when(F.coalesce(caption, F.lit("")) != "", text("Video description: ", F.trim(caption), "\n\n")).otherwise("")
    return text(image_block(n), described, closing)


def generation_answer(backward: Column) -> Column:
    return F.when(backward, ANSWER_PREVIOUS).otherwise(ANSWER_NEXT)


def action_prompt(n: Column, action: Column | None, scene: str = "an egocentric kitchen video") -> Column:
    """First-person generation, with the action to perform or without."""
    head = text(image_block(n), "These are ", n, f" consecutive first-person camera frames from {scene}. ")
    if action is None:
        return text(head, "Observe these frames and produce the next frame of the video.")
    return text(head, "Action being performed after the last frame: ", action, "\nObserve these frames and, given the action, produce the next frame of the video.")


def camera_prompt(n: Column, action: Column | None) -> Column:
    """Navigation; the wording says four frames whatever n is."""
    if action is None:
        return text(image_block(n), "Observe these four frames and produce the next frame of the video.")
    return text(image_block(n), "Action to execute from the last frame: ", action, "\nObserve these four frames and, given the action, produce the next frame of the video.")


def edit_prompt(action: Column) -> Column:
    return text(
        "<image>\nThis image is a single frame captured by a forward-facing camera. Apply the following camera action to it: ",
        action,
        "\nEdit the image to depict what the camera would see immediately after performing this action, keeping the same scene but updating the viewpoint accordingly.",
    )


def selection_prompt(n: Column, k: Column, scene: str, action: Column | None = None) -> Column:
    """Which of k options follows n frames."""
    body = text("These are ", n, f" consecutive {scene}.\n") if action is None else text("These are ", n, f" consecutive {scene}.\nAction being performed after the last frame: ", action, "\n")
    return text(numbered_frames(n), body, options(k), "Which option is the true next frame? Answer with a single letter (", letters(k), ").")


def choice_prompt(description: Column | None, k: int = 4) -> Column:
    """Three frames and k options, after a description of the scene if given."""
    names = [chr(65 + i) for i in range(k)]
    question = MULTIPLE_CHOICE.format(k=k, options="\n".join(f"Option {x}: <image>" for x in names), letters=", ".join(names[:-1]) + f", or {names[-1]}")
    head = "<image>\n" * 3
    return F.lit(head + question) if description is None else text(head, description, "\n\n" + question)


def progression_prompt(n: Column, caption: Column) -> Column:
    return text(image_block(n), F.trim(caption), "\n\n", filled(PROGRESSION, count=number_word(n)))


def labelling_prompt(n: Column, caption: Column) -> Column:
    return filled(LABELLING, total=n + 1, n=n, caption=with_period(caption))


def navigation_prefix(n: Column, action: Column) -> Column:
    return text(filled(NAVIGATION, count=number_word(n)), " ", action)


def kitchen_prefix(n: Column, action: Column) -> Column:
    return filled(KITCHEN_PREFIX, n=n, action=action)


def navigation_action_prefix(n: Column, action: Column) -> Column:
    return text(filled(NAVIGATION, count=number_word(n)), " Action to execute from the last frame: ", action)


def video_prefix(caption: Column) -> Column:
    return text("Video description: ", F.regexp_replace(caption, r"\A\s+|\s+\z", ""))


def labelled_parts(response: Column) -> tuple[Column, Column]:
    """(progression, next frame) of a labelling response, null unless both are there."""
    first = squeeze(F.regexp_extract(response, r"(?s)Progression:\s*(.*?)(?:\n+Next frame:|\z)", 1))
    second = squeeze(F.regexp_extract(response, r"(?s)Next frame:\s*(.*)", 1))
    both = (first != "") & (second != "")
    return F.when(both, first), F.when(both, second)


def answer_turn(progression: Column, following: Column) -> Column:
    return text(with_period(progression), f" {PREDICTION_MARK} ", with_period(following), f" {ANSWER_NEXT}")


def nearest_colour(r: Column, g: Column, b: Column) -> Column:
    """Named colour at the least squared distance, the earlier one on ties."""
    best = F.array_min(
        F.array(
            *[
                F.struct((F.pow(r - x, 2) + F.pow(g - y, 2) + F.pow(b - z, 2)).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name"))
                for i, (name, (x, y, z)) in enumerate(NAMED_COLOURS.items())
            ]
        )
    )
    return F.when(r.isNull() | g.isNull() | b.isNull(), "colored").otherwise(best["name"])


def frame_path(root: str, clip: Column, index: Column, ending: str = "jpg") -> Column:
    return text(f"{root}/", clip, "/", index, f".{ending}")


def frame_of(path: Column) -> tuple[Column, Column]:
    """(clip, index) of a frame path."""
    return F.regexp_extract(path, r"([^/]+)/\d+\.[^./]+\z", 1), F.regexp_extract(path, r"(\d+)\.[^./]+\z", 1).cast("int")


def short_task(generator: Column) -> Column:
    return F.regexp_extract(generator, "^[^_]+_(.*)_data-generator", 1)
