"""Relational scoring of detected objects.

An object is (image_id, role, idx, x, y, area, lab, shape); role is input, cand
or gt.  Images hold about ten objects, so pairs are formed within an image only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

# -- fixed values ----------------------------------------------------------
PLACEMENT_WEIGHTS = {"color_matching": 0.30 / 0.80, "alignment": 0.25 / 0.80, "fidelity": 0.15 / 0.80, "star_invariance": 0.10 / 0.80}
MARKER_TOLERANCE = 14.0
RADIUS_FACTORS = {"circle": 1.0, "square": 2.0**0.5, "triangle": 2.0**0.5, "star": 2.0**0.5, "rectangle": ((0.75) ** 2 + (0.5) ** 2) ** 0.5 * 1.1}


#: Areas in pixels: less is debris, then a marker, from the second on a shape.
MARKER_LEAST, SHAPE_LEAST = 30.0, 600.0


def by_area(objects: DataFrame, marker_least: float = MARKER_LEAST, shape_least: float = SHAPE_LEAST) -> DataFrame:
    """Objects that aren't debris, with ``kind``: marker or shape.  A null area is debris."""
    found = objects.filter(F.col("area") >= marker_least)
    return found.withColumn("kind", F.when(F.col("area") >= shape_least, "shape").otherwise("marker"))


def of_role(objects: DataFrame, role: str, prefix: str) -> DataFrame:
    """Objects of a role as one struct column."""
    return objects.filter(F.col("role") == role).select("image_id", F.struct("idx", "x", "y", "area", "lab", "shape").alias(prefix))


def pairs(objects: DataFrame, left: str, right: str) -> DataFrame:
    """image_id, a, b, de, dist for all object pairs of two roles in an image."""
    a, b = of_role(objects, left, "a"), of_role(objects, right, "b")
    return a.join(b, "image_id").withColumns({"de": S.lab_distance(F.col("a.lab"), F.col("b.lab")), "dist": S.centroid_distance(F.col("a"), F.col("b"))})


def _greedy(max_de: float, weight: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows.de <= max_de].assign(cost=lambda r: r.de + weight * r.dist).sort_values(["cost", "gt", "cand", "dist"])
        used_g, used_c, out = set(), set(), []
        for r in rows.itertuples():
            if r.gt in used_g or r.cand in used_c:
                continue
            used_g.add(r.gt)
            used_c.add(r.cand)
            out.append((r.image_id, r.gt, r.cand, r.dist))
        return pd.DataFrame(out, columns=["image_id", "gt", "cand", "dist"])

    return run


def greedy_match(objects: DataFrame, max_de: float = S.SAME_COLOUR, weight: float = 1.0) -> DataFrame:
    """One-to-one matches of reference to candidate objects, cheapest first.

    Colour is a gate; the cost is colour distance plus weighted distance.
    Reference objects without a partner have a null candidate.
    """
    flat = pairs(objects, "gt", "cand").select("image_id", F.col("a.idx").alias("gt"), F.col("b.idx").alias("cand"), "de", "dist")
    found = flat.groupBy("image_id").applyInPandas(_greedy(max_de, weight), "image_id string, gt int, cand int, dist double")
    every = of_role(objects, "gt", "a").select("image_id", F.col("a.idx").alias("gt"))
    return every.join(found, ["image_id", "gt"], "left")


def _slots(radius: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for slot, own in rows.sort_values(["slot", "dist", "cand"]).groupby("slot", sort=True):
            free = own[(own.dist <= radius) & ~own.cand.isin(taken)]
            pick = free.iloc[0] if len(free) else None
            if pick is not None:
                taken.add(pick.cand)
            out.append((own.image_id.iloc[0], slot, None if pick is None else int(pick.cand)))
        return pd.DataFrame(out, columns=["image_id", "slot", "cand"]).astype({"cand": "Int64"})

    return run


def nearest_per_slot(objects: DataFrame, radius: float) -> DataFrame:
    """Slots (reference objects in order) each take the nearest free candidate."""
    flat = pairs(objects, "gt", "cand").select("image_id", F.col("a.idx").alias("slot"), F.col("b.idx").alias("cand"), "dist")
    return flat.groupBy("image_id").applyInPandas(_slots(radius), "image_id string, slot int, cand long")


def markers_in_place(markers: DataFrame, tolerance: float = MARKER_TOLERANCE) -> DataFrame:
    """Share of drawn markers with a same-coloured input marker close by; 1 if none is drawn."""
    drawn = markers.select("image_id").distinct()
    near = pairs(markers, "cand", "input").filter((F.col("de") <= S.SAME_COLOUR) & (F.col("dist") <= tolerance)).select("image_id", F.col("a.idx").alias("idx")).distinct()
    ok = near.groupBy("image_id").agg(F.count("*").alias("ok"))
    n = markers.filter("role = 'cand'").groupBy("image_id").agg(F.count("*").alias("n"))
    return drawn.join(n, "image_id", "left").join(ok, "image_id", "left").select("image_id", F.when(F.col("n").isNull(), 1.0).otherwise(F.coalesce("ok", F.lit(0)) / F.col("n")).alias("star_invariance"))


def palette_gaps(objects: DataFrame, left: str = "gt", right: str = "cand") -> DataFrame:
    """Objects of one role without a like-coloured one of the other role."""
    a = of_role(objects, left, "a").select("image_id", F.col("a.idx").alias("idx"))
    near = pairs(objects, left, right).filter(F.col("de") <= S.SAME_COLOUR).select("image_id", F.col("a.idx").alias("idx"))
    return a.join(near, ["image_id", "idx"], "left_anti")


def sources_of(objects: DataFrame) -> DataFrame:
    """The input object of the most similar colour for each reference object."""
    best = F.min_by(F.struct(F.col("b.idx").alias("idx"), F.col("b.area").alias("area"), F.col("b.shape").alias("shape"), F.col("de").alias("de")), F.struct("de", F.col("b.idx"))).alias("src")
    return pairs(objects, "gt", "input").groupBy("image_id", F.col("a.idx").alias("gt")).agg(best)


def palette(labs: Column, gate: float = S.SAME_COLOUR) -> Column:
    """Colours of an image, each the first of those close to it, in order."""
    return F.aggregate(labs, F.slice(labs, 1, 0), lambda kept, lab: F.when(F.exists(kept, lambda k: S.lab_distance(k, lab) <= gate), kept).otherwise(F.concat(kept, F.array(lab))))


def placement_scores(shapes: DataFrame, markers: DataFrame, ceilings: DataFrame, on_target: float = 0.60, good: float = 0.20, bad: float = 0.80) -> DataFrame:
    """Sub-scores of object placement, and their weighted sum, per image.

    on_target, good, bad: distances as parts of an object's side.
    """
    side = F.sqrt(F.greatest(F.lit(1.0), F.col("g.area")))
    matched = greedy_match(shapes)
    g, c = of_role(shapes, "gt", "g"), of_role(shapes, "cand", "c")
    rows = matched.join(g.withColumn("gt", F.col("g.idx")), ["image_id", "gt"])
    rows = rows.join(c.withColumn("cand", F.col("c.idx")), ["image_id", "cand"], "left")
    rows = rows.join(sources_of(shapes), ["image_id", "gt"], "left")
    hit = F.when(F.col("dist") <= on_target * side, 1.0).otherwise(0.0)
    align = F.when(F.col("dist").isNull(), 0.0).otherwise(S.band(F.col("dist"), good * side, bad * side))
    ratio = F.least(F.col("c.area"), F.col("src.area")) / F.greatest(F.col("c.area"), F.col("src.area"), F.lit(1.0))
    like = F.when(F.col("c.shape") == F.col("src.shape"), 0.5).otherwise(0.0) + 0.5 * S.band(1.0 - ratio, 0.15, 0.60)
    fidelity = F.when(F.col("cand").isNull() | F.col("src").isNull() | (F.col("src.de") > S.SAME_COLOUR), 0.0).otherwise(like)
    sums = rows.groupBy("image_id").agg(F.avg(hit).alias("_hit"), F.avg(align).alias("_align"), F.avg(fidelity).alias("_fid"))
    sizes = shapes.groupBy("image_id").agg(F.greatest(F.lit(0), F.count_if(F.col("role") == "cand") - F.count_if(F.col("role") == "gt")).alias("_extra"))
    out = sums.join(sizes, "image_id").join(ceilings, "image_id").join(markers_in_place(markers), "image_id", "left")
    penalty = F.least(F.lit(0.5), 0.25 * F.col("_extra"))
    parts = {
        "color_matching": F.greatest(F.lit(0.0), F.col("_hit") - penalty),
        "alignment": F.greatest(F.lit(0.0), F.col("_align") - 0.5 * penalty),
        "fidelity": F.col("_fid"),
        "star_invariance": F.coalesce("star_invariance", F.lit(1.0)),
    }
    mapped = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), S.clamp(v) * F.col("ceiling"))])
    return out.select("image_id", mapped.alias("sub")).withColumn("score", S.overall(F.col("sub"), PLACEMENT_WEIGHTS))


def effective_radius(size: Column, shape: Column) -> Column:
    factor = F.lit(2.0**0.5)
    for name, value in RADIUS_FACTORS.items():
        factor = F.when(F.lower(shape) == name, value).otherwise(factor)
    return size * F.when(shape.isNull(), 1.0).otherwise(factor)


def boxes_overlap(x1: Column, y1: Column, s1: Column, x2: Column, y2: Column, s2: Column) -> Column:
    return (F.abs(x1 - x2) <= s1 + s2) & (F.abs(y1 - y2) <= s1 + s2)


def valid_layouts(items: DataFrame, gap: float) -> DataFrame:
    """Per layout whether no two items (layout, idx, x, y, size, shape) are too close."""
    rows = items.withColumn("_r", effective_radius(F.col("size"), F.col("shape")))
    a, b = (rows.select("layout", *[F.col(c).alias(f"{c}{k}") for c in ("idx", "x", "y", "_r")]) for k in (1, 2))
    close = a.join(b, "layout").filter((F.col("idx1") < F.col("idx2")) & (F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")) < F.col("_r1") + F.col("_r2") + gap)).select("layout").distinct()
    every = items.select("layout").distinct()
    return every.join(close.withColumn("_bad", F.lit(True)), "layout", "left").select("layout", F.col("_bad").isNull().alias("valid"))


def grid_cells(objects: DataFrame, row_height: float) -> DataFrame:
    """Row and column of each object, by rows of a height and x within them."""
    line = F.floor(F.col("y") / row_height).cast("int")
    rows = objects.withColumn("row", F.dense_rank().over(Window.partitionBy("image_id").orderBy(line)) - 1)
    return rows.withColumn("column", F.row_number().over(Window.partitionBy("image_id", "row").orderBy("x", "idx")) - 1)


def largest(objects: DataFrame, preferred: Column) -> DataFrame:
    """The largest object of an image among preferred ones, else among all."""
    return objects.groupBy("image_id").agg(F.max_by("idx", F.struct(F.when(preferred, 1).otherwise(0), F.col("area"), -F.col("idx"))).alias("idx"))


def lab_of(bgr: np.ndarray) -> np.ndarray:
    """8-bit BGR to Lab in 8-bit scale (L * 255 / 100, a and b + 128)."""
    rgb = np.asarray(bgr, dtype=np.float64)[..., ::-1] / 255.0
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    xyz = linear @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]])
    xyz = xyz / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * np.cbrt(xyz[..., 1]) - 16, 903.3 * xyz[..., 1])
    return np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
