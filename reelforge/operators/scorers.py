"""Image scorers: sub-scores of a candidate against input and reference.

A scorer maps three images to a dict of sub-scores in 0..1.  ``score_images``
runs a registry of them over rows with image bytes, one result for each row; a
scorer that fails gives an error and no score, and stops nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import scores as S
from .objects import PLACEMENT_WEIGHTS, lab_of

Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, float]]

# -- fixed values ----------------------------------------------------------
WEIGHTS: dict[str, dict[str, float]] = {
    "rotation_puzzle": {"path_connection": 0.40, "rotation_accuracy": 0.30, "position_preservation": 0.20, "alignment_precision": 0.10},
    "multi_object_placement": PLACEMENT_WEIGHTS,
    "shape_color_then_move": {"first_row_preservation": 0.40, "second_row_completion": 0.35, "color_accuracy": 0.20, "shape_count": 0.05},
    "2d_geometric_transformation": {"rotation_angle": 0.35 / 0.70, "position_alignment": 0.25 / 0.70, "shape_fidelity": 0.10 / 0.70},
}
CELLS = {"TL": (138, 138, 110, 110), "TR": (263, 138, 110, 110), "BL": (138, 263, 110, 110), "BR": (263, 263, 110, 110)}
ARM_REACH, ARM_BAND = 8, (0.28, 0.72)
JUNCTIONS = (("TL", "E", "TR", "W"), ("BL", "E", "BR", "W"), ("TL", "S", "BL", "N"), ("TR", "S", "BR", "N"))
OUTWARD = {"TL": "NW", "TR": "NE", "BL": "SW", "BR": "SE"}
DEBRIS_AREA, MARKER_AREA = 30.0, 600.0
ON_TARGET, ALIGNED = 0.60, (0.20, 0.80)  # parts of an object's side
TURN_BAND, RIGID_BAND, IDENTITY_BAND = (8.0, 45.0), (0.20, 0.45), (0.55, 0.80)
POLYGON_AREA, OUTLINE_WEIGHT = 300, 0.25
CELL_AREA, CELL_BAND, GLYPH_BAND, CELLS_OF_ANALOGY, ROW_SPLIT = 200, (10.0, 45.0), (0.15, 0.40), 6, 0.5


def ramp(value: float, good: float, bad: float) -> float:
    return float(np.interp(value, [good, max(bad, good + 1e-9)], [1.0, 0.0]))


def ceiling(candidate: np.ndarray, reference: np.ndarray) -> float:
    """What a nearly blank or repainted candidate can score at most."""
    share = I.drawn(candidate).sum() / max(1, I.drawn(reference).sum())
    out = (0.0, 0.25, 0.6, 1.0)[int(np.searchsorted([0.05, 0.15, 0.30], share, side="right"))]
    repainted = I.colour_gap(lab_of(I.background(candidate)), lab_of(I.background(reference))) > 40
    return min(out, 0.15) if repainted else out


def _arms(mask: np.ndarray, cell: tuple[int, int, int, int]) -> dict[str, float]:
    """Sides that the pipe reaches, with where it crosses them."""
    x, y, w, h = cell
    tile = mask[y : y + h, x : x + w]
    out = {}
    for side, turned in (("N", tile), ("S", tile[::-1]), ("W", tile.T), ("E", tile.T[::-1])):
        low, high = (int(b * turned.shape[1]) for b in ARM_BAND)
        rows = np.flatnonzero(turned[:, low:high].any(axis=1))
        near = turned[: ARM_REACH + 1, low:high]
        if len(rows) and rows[0] <= ARM_REACH and near.mean() > 0:
            out[side] = float(np.nonzero(turned[: turned.shape[0] // 5, low:high])[1].mean() + low)
    return out


def _tiles(image: np.ndarray) -> set[str]:
    """Cells that hold a bright square."""
    pale = (image.min(axis=2) >= 253) & ~I.coloured(image)
    return {k for k, (x, y, w, h) in CELLS.items() if (pale[y : y + h, x : x + w] | I.coloured(image)[y : y + h, x : x + w]).mean() > 0.7}


def rotation_puzzle(before: np.ndarray, candidate: np.ndarray, reference: np.ndarray) -> dict[str, float]:
    want_mask, have_mask = (I.closed(I.coloured(i)) for i in (reference, candidate))
    want = {k: _arms(want_mask, c) for k, c in CELLS.items()}
    have = {k: _arms(have_mask, c) for k, c in CELLS.items()}
    top = ceiling(candidate, reference)
    ink = have_mask.sum() / max(1, want_mask.sum())
    top = min(top, 0.1 if ink < 0.15 else 0.5 if ink < 0.35 else 1.0)
    same = have_mask.any() and I.colour_gap(lab_of(I.modal_colour(candidate, have_mask)), lab_of(I.modal_colour(reference, want_mask))) <= S.SAME_COLOUR
    turned = [1.0 if want[k].keys() == have[k].keys() else 0.5 * len(want[k].keys() & have[k].keys()) / len(want[k].keys() | have[k].keys()) for k in CELLS]
    needed = [j for j in JUNCTIONS if j[1] in want[j[0]] and j[3] in want[j[2]]]
    joined = [j for j in needed if j[1] in have[j[0]] and j[3] in have[j[2]]]
    loose = sum(side in have[k] for k, sides in OUTWARD.items() for side in sides)
    offsets = [ramp(abs(have[a][da] - have[b][db]), 3.0, 14.0) for a, da, b, db in joined]
    tiles = _tiles(candidate)
    place = [(0.6 + 0.4 * (k in tiles)) if have_mask[y : y + h, x : x + w].sum() > 40 else 0.5 * (k in tiles) for k, (x, y, w, h) in CELLS.items()]
    colour = 1.0 if same else 0.5
    return {
        "path_connection": top * colour * max(0.0, len(joined) / max(1, len(needed)) - 0.25 * loose),
        "rotation_accuracy": top * colour * float(np.mean(turned)),
        "position_preservation": top * float(np.mean(place)),
        "alignment_precision": top * colour * (sum(offsets) / len(needed) if needed else 0.0),
    }


def _main(image: np.ndarray, like: np.ndarray | None = None) -> I.Region | None:
    """The largest region, of a colour if there is one of it."""
    found = I.regions(image, I.drawn(image, 20.0) & I.coloured(image) if I.coloured(image).any() else I.drawn(image, 20.0), POLYGON_AREA)
    alike = [r for r in found if like is not None and I.colour_gap(r.lab, like) <= S.SAME_COLOUR]
    return (alike or found or [None])[0]


def _grey_ink(image: np.ndarray) -> int:
    """Pixels of neutral grey that are darker than the background: outline and pivot."""
    ground, pixels = I.background(image).astype(np.float64), image.astype(np.float64)
    unlike = np.sqrt(((pixels - ground) ** 2).sum(axis=2)) > 12.0
    neutral = np.ptp(pixels, axis=2) < 22.0
    return int((unlike & neutral & (pixels.mean(axis=2) < ground.mean() - 6.0)).sum())


def _outline_left(before: np.ndarray, candidate: np.ndarray, reference: np.ndarray) -> float:
    """The share of the target's outline that should be gone and isn't."""
    start, now, goal = (_grey_ink(i) for i in (before, candidate, reference))
    return min(1.0, max(0.0, (now - goal) / max(1.0, start - goal)))


def geometric_transformation(before: np.ndarray, candidate: np.ndarray, reference: np.ndarray) -> dict[str, float]:
    goal = _main(reference)
    now = _main(candidate, goal.lab) if goal else None
    start = _main(before, goal.lab) if goal else None
    if goal is None or now is None:
        return dict.fromkeys(WEIGHTS["2d_geometric_transformation"], 0.0)
    top = ceiling(candidate, reference) * (1.0 if I.colour_gap(goal.lab, now.lab) <= S.SAME_COLOUR else 0.5)
    side = goal.area**0.5
    path = float(np.hypot(start.x - goal.x, start.y - goal.y)) if start else 0.0
    turn, fit = I.best_turn(goal, now)
    like = ramp(1 - fit, *IDENTITY_BAND)
    place = ramp(float(np.hypot(now.x - goal.x, now.y - goal.y)), max(0.1 * side, 3.0), max(path, 0.3 * side)) * like
    faithful = 0.0
    if start:
        _, rigid = I.best_turn(start, now)
        size = min(now.area, start.area) / max(now.area, start.area, 1.0)
        faithful = 0.5 * ramp(1 - rigid, *RIGID_BAND) + 0.5 * ramp(1 - size, 0.15, 0.55)
    top *= 1.0 - OUTLINE_WEIGHT * _outline_left(before, candidate, reference)
    return {"rotation_angle": top * ramp(abs(turn), *TURN_BAND) * like, "position_alignment": top * place, "shape_fidelity": top * faithful}


def _objects(image: np.ndarray) -> tuple[list[I.Region], list[I.Region]]:
    found = I.regions(image, I.coloured(image), DEBRIS_AREA)
    return [r for r in found if r.area >= MARKER_AREA], [r for r in found if r.area < MARKER_AREA]


def _assigned(goals: list[I.Region], have: list[I.Region], gate: float = S.SAME_COLOUR) -> list[tuple[I.Region, I.Region | None, float]]:
    """Each goal with the partner that a cheapest-first pairing leaves it."""
    costs = sorted((I.colour_gap(g.lab, c.lab) + np.hypot(g.x - c.x, g.y - c.y), i, j) for i, g in enumerate(goals) for j, c in enumerate(have) if I.colour_gap(g.lab, c.lab) <= gate)
    of: dict[int, int] = {}
    for _, i, j in costs:
        if i not in of and j not in of.values():
            of[i] = j
    return [(g, have[of[i]] if i in of else None, float(np.hypot(g.x - have[of[i]].x, g.y - have[of[i]].y)) if i in of else np.inf) for i, g in enumerate(goals)]


def object_placement(before: np.ndarray, candidate: np.ndarray, reference: np.ndarray) -> dict[str, float]:
    goals, _ = _objects(reference)
    have, drawn_markers = _objects(candidate)
    sources, markers = _objects(before)
    if not goals:
        return dict.fromkeys(PLACEMENT_WEIGHTS, 0.0)
    top, hit, near, alike = ceiling(candidate, reference), [], [], []
    for goal, own, away in _assigned(goals, have):
        side = goal.area**0.5
        hit.append(float(own is not None and away <= ON_TARGET * side))
        near.append(0.0 if own is None else ramp(away, ALIGNED[0] * side, ALIGNED[1] * side))
        source = min(sources, key=lambda s: I.colour_gap(s.lab, goal.lab), default=None)
        if own is None or source is None or I.colour_gap(source.lab, goal.lab) > S.SAME_COLOUR:
            alike.append(0.0)
        else:
            size = min(own.area, source.area) / max(own.area, source.area)
            alike.append(0.5 * (own.shape == source.shape) + 0.5 * ramp(1 - size, 0.15, 0.60))
    extra = min(0.5, 0.25 * max(0, len(have) - len(goals)))
    kept = [any(I.colour_gap(m.lab, s.lab) <= S.SAME_COLOUR and np.hypot(m.x - s.x, m.y - s.y) <= 14 for s in markers) for m in drawn_markers]
    return {
        "color_matching": top * max(0.0, float(np.mean(hit)) - extra),
        "alignment": top * max(0.0, float(np.mean(near)) - 0.5 * extra),
        "fidelity": top * float(np.mean(alike)),
        "star_invariance": top * (float(np.mean(kept)) if kept else 1.0),
    }


def _glyph_overlap(a: I.Region, b: I.Region) -> float:
    """Overlap of two masks laid on one centre, as intersection over union."""
    height, width = a.mask.shape
    y, x = np.nonzero(b.mask)
    y, x = y + int(np.round(a.y - b.y)), x + int(np.round(a.x - b.x))
    inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
    laid = np.zeros_like(a.mask)
    laid[y[inside], x[inside]] = True
    return float((a.mask & laid).sum() / max(1, (a.mask | laid).sum()))


def colour_then_move(before: np.ndarray, candidate: np.ndarray, reference: np.ndarray) -> dict[str, float]:
    """Six cells of the reference in two rows; each takes the nearest free candidate
    within the band, and is worth place times glyph times colour."""
    goals, have = (I.regions(i, I.opened(I.closed(I.drawn(i, 25.0))), CELL_AREA) for i in (reference, candidate))
    middle = ROW_SPLIT * reference.shape[0]
    upper, lower = (sorted([g for g in goals if (g.y < middle) == top_row], key=lambda g: g.x)[:3] for top_row in (True, False))
    if len(upper) + len(lower) < CELLS_OF_ANALOGY:
        return dict.fromkeys(WEIGHTS["shape_color_then_move"], 0.0)
    top, free = ceiling(candidate, reference), list(have)
    worth, coloured = [], []
    for goal in upper + lower:
        own = min(free, key=lambda r: np.hypot(r.x - goal.x, r.y - goal.y), default=None)
        away = np.inf if own is None else float(np.hypot(own.x - goal.x, own.y - goal.y))
        if away > CELL_BAND[1]:
            worth.append(0.0)
            coloured.append(0.0)
            continue
        free = [r for r in free if r is not own]
        coloured.append(float(I.colour_gap(own.lab, goal.lab) <= S.SAME_COLOUR))
        worth.append(ramp(away, *CELL_BAND) * ramp(1.0 - _glyph_overlap(goal, own), *GLYPH_BAND) * coloured[-1])
    first = float(np.mean(worth[:3]))
    readable = min(1.0, first / 0.5)  # without its example, the second row means nothing
    return {
        "first_row_preservation": top * first,
        "second_row_completion": top * readable * float(np.mean(worth[3:])),
        "color_accuracy": top * readable * float(np.mean(coloured[4:])),
        "shape_count": top * ramp(abs(len(have) - CELLS_OF_ANALOGY), 0.0, 3.0),
    }


SCORERS: dict[str, Scorer] = {
    "rotation_puzzle": rotation_puzzle,
    "multi_object_placement": object_placement,
    "shape_color_then_move": colour_then_move,
    "2d_geometric_transformation": geometric_transformation,
}


def image_of(row: pd.Series, name: str) -> np.ndarray:
    """BGR pixels of an image struct (height, width, nChannels, data)."""
    image = row[name]
    pixels = np.frombuffer(image["data"], dtype=np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    return I.resized(np.repeat(pixels, 3, axis=2) if pixels.shape[2] == 1 else pixels[:, :, :3])


def score_images(rows: DataFrame, registry: dict[str, Scorer] | None = None, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """run, id, task_name, score, error, sub from rows with before, candidate and
    reference images.  A task without a scorer gives an error."""
    known, by = SCORERS | (registry or {}), WEIGHTS | (weights or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                score, error, sub = None, None, None
                try:
                    sub = known[row["task_name"]](*(image_of(row, n) for n in ("before", "candidate", "reference")))
                    score = float(sum(sub[k] * w for k, w in by[row["task_name"]].items()))
                except Exception as e:  # the record says what went wrong
                    error = f"{type(e).__name__}: {e}"
                out.append((row["run"], row["id"], row["task_name"], score, error, sub))
            yield pd.DataFrame(out, columns=["run", "id", "task_name", "score", "error", "sub"])

    return rows.select("run", "id", "task_name", "before", "candidate", "reference").mapInPandas(run, "run string, id string, task_name string, score double, error string, sub map<string,double>")


def scored_with_overall(scored: DataFrame, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The overall score again from the sub-scores, as a column expression."""
    out = F.lit(None).cast("double")
    for task, by in (WEIGHTS | (weights or {})).items():
        out = F.when(F.col("task_name") == task, S.overall(F.col("sub"), by)).otherwise(out)
    return scored.withColumn("overall", out)
