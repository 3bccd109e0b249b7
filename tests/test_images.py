"""Scorers on redrawn scenes: bounds and orderings, not exact values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelforge.functions import images as I
from reelforge.functions import scenes
from reelforge.operators import scorers

SIZE = 512
YY, XX = np.mgrid[:SIZE, :SIZE]


def blank(colour=(255, 255, 255)):
    return np.full((SIZE, SIZE, 3), colour, dtype=np.uint8)


def paint(image, mask, colour):
    image[mask] = colour
    return image


def box(x, y, w, h):
    return (abs(XX - x) <= w / 2) & (abs(YY - y) <= h / 2)


def disc(x, y, r):
    return np.hypot(XX - x, YY - y) <= r


def ngon(x, y, r, n, turn):
    angle = np.radians(turn) + np.arange(n) * 2 * np.pi / n
    px, py = x + r * np.cos(angle), y + r * np.sin(angle)
    inside = np.ones((SIZE, SIZE), dtype=bool)
    for i in range(n):
        j = (i + 1) % n
        inside &= (px[j] - px[i]) * (YY - py[i]) - (py[j] - py[i]) * (XX - px[i]) >= 0
    return inside


def star(x, y, r, points=5):
    d, t = np.hypot(XX - x, YY - y), np.arctan2(YY - y, XX - x)
    wave = np.abs(((t / (2 * np.pi) * points) % 1) - 0.5) * 2
    return d <= r * (0.4 + 0.6 * wave)


def puzzle(arms):
    image = blank((248, 250, 252))
    for key, (x, y, w, h) in scorers.CELLS.items():
        image[y : y + h, x : x + w] = 255
        cx, cy = x + w // 2, y + h // 2
        for side in arms[key]:
            a, b, c, d = {"N": (cx - 3, cx + 3, y, cy), "S": (cx - 3, cx + 3, cy, y + h), "W": (x, cx, cy - 3, cy + 3), "E": (cx, x + w, cy - 3, cy + 3)}[side]
            image[c:d, a:b] = (0, 165, 255)
    return image


SOLVED = {"TL": "ES", "TR": "SW", "BL": "EN", "BR": "NW"}


def total(task, before, candidate, reference):
    return sum(v * scorers.WEIGHTS[task][k] for k, v in scorers.SCORERS[task](before, candidate, reference).items())


def test_rotation_puzzle():
    start, goal = puzzle({"TL": "NW", "TR": "SW", "BL": "EN", "BR": "NW"}), puzzle(SOLVED)
    score = lambda c: total("rotation_puzzle", start, c, goal)
    assert score(goal) > 0.95 and score(blank((248, 250, 252))) < 0.1
    assert 0.2 < score(start) < 0.9
    worse = puzzle(SOLVED | {"TR": "NE", "BL": "SW"})
    assert score(worse) < score(start)
    recoloured = goal.copy()
    recoloured[I.coloured(goal)] = (200, 30, 30)
    assert score(recoloured) < 0.7
    assert score(255 - goal) < 0.3


def placement(places, colours=((255, 100, 100), (100, 255, 100), (100, 165, 255)), stars=()):
    image = blank()
    for (x, y), c in zip(places, colours, strict=False):
        paint(image, box(x, y, 56, 56), c)
    for (x, y), c in zip(stars, colours, strict=False):
        paint(image, star(x, y, 9), c)
    return image


def test_object_placement():
    here, there = [(90, 100), (90, 250), (90, 400)], [(400, 110), (300, 260), (420, 390)]
    start, goal = placement(here, stars=there), placement(there)
    score = lambda c: total("multi_object_placement", start, c, goal)
    assert score(goal) > 0.9 and score(blank()) < 0.1
    near = [total("multi_object_placement", start, placement([(x + d, y) for x, y in there]), goal) for d in (0, 15, 40, 90)]
    assert near == sorted(near, reverse=True) and near[0] > near[-1] + 0.3
    one_off = placement([there[0], there[1], (100, 480)])
    assert abs(scorers.object_placement(start, one_off, goal)["color_matching"] - 2 / 3) < 0.05
    swapped = placement(there, colours=((30, 30, 200), (200, 30, 200), (20, 20, 20)))
    assert scorers.object_placement(start, swapped, goal)["color_matching"] < 0.1


def test_colour_then_move():
    def scene(shift, second=(40, 170, 210)):
        image = blank()
        for i, x in enumerate((96, 240, 384)):
            paint(image, box(x, 150, 78, 78), (60, 40, 150) if i == 0 else (40, 170, 210))
            paint(image, disc(x, 370 + (shift if i == 2 else 0), 39), (60, 40, 150) if i == 0 else second)
        return image

    start, goal = scene(0, (60, 40, 150)), scene(-50)
    score = lambda c: total("shape_color_then_move", start, c, goal)
    assert score(goal) > 0.9 and score(blank()) < 0.1
    assert score(scene(-50, (200, 60, 60))) < score(scene(-20)) < score(goal)


def test_geometric_transformation():
    def scene(x, y, turn, r=70, sides=(1.0, 0.45)):
        image = blank((240, 240, 240))
        angle = np.radians(turn)
        u = (XX - x) * np.cos(angle) + (YY - y) * np.sin(angle)
        v = -(XX - x) * np.sin(angle) + (YY - y) * np.cos(angle)
        return paint(image, (abs(u) <= r * sides[0]) & (abs(v) <= r * sides[1]) & ~((u > 0) & (v > 0)), (135, 160, 60))

    start, goal = scene(170, 300, 0), scene(255, 255, 70)
    score = lambda c: total("2d_geometric_transformation", start, c, goal)
    assert score(goal) > 0.9 and score(blank((240, 240, 240))) < 0.05
    turned = [score(scene(255, 255, 70 + d)) for d in (0, 12, 45)]
    assert turned == sorted(turned, reverse=True)
    assert scorers.geometric_transformation(start, start, goal)["position_alignment"] < 0.1


def test_shapes_and_regions():
    image = blank()
    for mask, colour in ((disc(100, 100, 40), (255, 0, 0)), (box(300, 100, 90, 60), (0, 255, 0)), (ngon(100, 320, 50, 3, 20), (0, 0, 255)), (star(320, 320, 60), (200, 0, 200)), (ngon(430, 430, 45, 5, 10), (0, 128, 128))):
        paint(image, mask, colour)
    found = {r.shape for r in I.regions(image, I.drawn(image))}
    assert {"circle", "quad", "triangle", "star"} <= found  # a regular pentagon is round enough for a circle
    numbers = I.labelled(I.drawn(image))
    assert numbers.max() == 5 and set(np.unique(numbers)) == set(range(6))
    comb = np.zeros((20, 21), dtype=bool)
    comb[:, ::2] = True
    assert I.labelled(comb).max() == 11
    comb[19] = True
    assert I.labelled(comb).max() == 1
    assert abs(I.axis_angle(box(200, 200, 120, 20)) % 180) < 1
    a, b = (I.regions(paint(blank(), ngon(x, 250, 60, 3, t), (0, 0, 0)), ngon(x, 250, 60, 3, t))[0] for x, t in ((250, 0), (200, 30)))
    turn, fit = I.best_turn(a, b)
    assert fit > 0.9
    assert I.off_palette_share(image, image) == 0 and I.off_palette_share(paint(image.copy(), box(400, 200, 50, 50), (10, 250, 250)), image) > 0.1


def test_resizing():
    image = np.random.default_rng(0).integers(0, 256, (300, 700, 3), dtype=np.uint8)
    out = I.resized(image)
    assert out.shape == (512, 512, 3) and abs(out.mean() - image.mean()) < 1
    assert (I.resized(blank()) == 255).all() and I.long_edge(1000, 500, 400) == (400, 200) and I.long_edge(10, 5, 400) == (10, 5)


def test_score_images(spark):
    def struct(image):
        return (image.shape[0], image.shape[1], 3, bytearray(image.tobytes()))

    goal = puzzle(SOLVED)
    rows = [("r", "1", "rotation_puzzle", struct(goal), struct(goal), struct(goal)), ("r", "2", "unknown", struct(goal), struct(goal), struct(goal)), ("r", "3", "rotation_puzzle", struct(goal), None, struct(goal))]
    image = "struct<height:int,width:int,nChannels:int,data:binary>"
    frame = spark.createDataFrame(rows, f"run string, id string, task_name string, before {image}, candidate {image}, reference {image}")
    got = {r.id: r for r in scorers.scored_with_overall(scorers.score_images(frame)).collect()}
    assert got["1"].score > 0.95 and abs(got["1"].overall - got["1"].score) < 1e-9
    assert got["2"].score is None and got["2"].error and got["3"].error


def test_scenes(spark):
    cases = [
        ("maze", {"grid_size": 7}, "top-down 7×7 grid-maze"),
        ("mirror_reflection", {"reflectivity": 0.5, "theta_incident_degrees": "?"}, "reflectivity 0.50 and incident angle a fixed angle."),
        ("gravity_physics", {"gravity": 9.806}, "under 9.81 m/s², shown"),
        ("shape_outline_then_move", {"move_to": "far_up"}, "it moves far up while"),
        ("key_door_matching", {"target_color": [250, 5, 5]}, "to the red diamond-shaped key"),
        ("grid_shift", {"direction": "right", "color": "teal"}, "teal square blocks all translate uniformly rightward by a total of several"),
        ("2d_geometric_transformation", {}, "video of a polygon rotating a fixed direction in place"),
        ("stable_sort", {}, "sorted smallest-to-largest"),
    ]
    frame = spark.createDataFrame([(t, json.dumps(p)) for t, p, _ in cases], "task string, p string")
    got = {r.task: r.s for r in frame.select("task", scenes.scenes(F.col("task"), F.col("p")).alias("s")).collect()}
    for task, _, part in cases:
        assert part in got[task], got[task]
    with pytest.raises(Exception, match="no scene"):
        spark.createDataFrame([("other", "{}")], "task string, p string").select(scenes.scenes(F.col("task"), F.col("p"))).collect()
    sums = scenes.criteria_table(spark).groupBy("task_name").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 10 and all(abs(r.w - 100) < 1e-6 for r in sums)
