"""Registered queries for the library's own operators, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import scores as S
from ..functions.draws import coin, draw
from ..operators import generators, joins, mining, objects, reports, rows, sets, splits, windows
from . import recipes
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CLIPS = """clips AS (SELECT user_id AS clip_id, CAST(count(*) AS INT) AS num_frames, CAST(user_id % 30 + 1 AS DOUBLE) AS fps FROM events GROUP BY user_id)"""
FRAMES = """frames AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id, event_type, value FROM events)"""
GRID = f"""{CLIPS}, strides AS (SELECT *, greatest(1, CAST(round_even(fps / 2.0, 0) AS INT)) AS st FROM clips),
grid AS (SELECT *, (num_frames - 1) // st + 1 AS n_grid FROM strides)"""
TRANSITIONS = f"""{GRID}, starts AS (SELECT clip_id, num_frames, st, unnest(range(2, n_grid - 2, 2)) AS cur FROM grid),
transitions AS (SELECT clip_id, clip_id || ':' || cur || ':' || (cur + 2) AS sample_id, cur AS "current", st, [g * st for g in range(cur - 2, cur + 1)] AS context_native, cur + 2 AS target_grid, (cur + 2) * st AS target_native
  FROM starts WHERE (cur + 2) * st < num_frames)"""
NEGATIVES = f"""{TRANSITIONS}, others AS (SELECT t.clip_id, t.sample_id, o.target_native AS native, abs(o.target_grid - t.target_grid) AS dist, o."current" AS place
    FROM transitions t JOIN transitions o ON t.clip_id = o.clip_id AND t.target_native <> o.target_native),
firsts AS (SELECT * FROM others QUALIFY row_number() OVER (PARTITION BY sample_id, native ORDER BY place) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY dist, place) AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM firsts),
negatives AS (SELECT sample_id, max(CASE WHEN r = 1 THEN native END) AS near, max(CASE WHEN r = 2 THEN native END) AS mid, arg_max(native, CASE WHEN r > 2 THEN dist * 1000000 - r END) AS far
    FROM ranked WHERE n >= 3 GROUP BY sample_id)"""
ANCHORS = f"""{NEGATIVES}, options AS (SELECT t.*, near, mid, far, list_sort([{{'h': md5('0:' || sample_id || ':' || target_native), 'value': target_native, 'kind': 'ground_truth'}},
   {{'h': md5('0:' || sample_id || ':' || near), 'value': near, 'kind': 'near_wrong_state'}}, {{'h': md5('0:' || sample_id || ':' || mid), 'value': mid, 'kind': 'mid_wrong_state'}},
   {{'h': md5('0:' || sample_id || ':' || far), 'value': far, 'kind': 'same_video_distractor'}}]) AS opts FROM transitions t JOIN negatives USING (sample_id)),
anchors AS (SELECT *, 'selection:' || sample_id AS example_id, ['frames/' || clip_id || '/' || i || '.jpg' for i in context_native] AS ctx, ['frames/' || clip_id || '/' || o.value || '.jpg' for o in opts] AS cands,
   [o.kind for o in opts] AS kinds, list_position([o.kind for o in opts], 'ground_truth') - 1 AS answer_index, 'step ' || "current" AS action_text FROM options)"""
SCORES = """scores AS (SELECT d.doc_id AS id, 's' || (d.doc_id % 3) AS run, source AS task_name, CASE WHEN lang = 'en' THEN 'ID' ELSE 'OOD' END AS domain,
   CASE WHEN d.doc_id % 11 <> 0 THEN (n_chars % 101) / 100.0::DOUBLE END AS rule_score, (quality * 3 + toxic + d.doc_id % 5) / 8.0::DOUBLE AS judge_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
PARTS = """parts AS (SELECT vec_id, k, embedding, k // 3 AS idx, ['input', 'cand', 'gt'][k % 3 + 1] AS role FROM (SELECT *, unnest(range(0, 9)) AS k FROM embeddings WHERE embedding IS NOT NULL))"""
OBJECTS = f"""{PARTS}, objects AS (SELECT CAST(vec_id AS VARCHAR) AS image_id, role, idx, embedding[k*6+4]::DOUBLE * 500 + 256 AS x, embedding[k*6+5]::DOUBLE * 500 + 256 AS y, abs(embedding[k*6+6]::DOUBLE) * 5000 + 100 AS area,
   embedding[k*6+1]::DOUBLE * 100 + 128 AS l, embedding[k*6+2]::DOUBLE * 100 + 128 AS a, embedding[k*6+3]::DOUBLE * 100 + 128 AS b, CASE WHEN embedding[k*6+1] > 0 THEN 'square' ELSE 'circle' END AS shape FROM parts)"""
DE = "sqrt(pow((p.l - q.l) * 0.5, 2) + pow(p.a - q.a, 2) + pow(p.b - q.b, 2))"


def query(name: str, sql: str | None = None):
    """Register a query and, if it can be written, its SQL."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def joined(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(column.cast("array<string>"), ",")


# -- windows ------------------------------------------------------------------


@query(
    "grid_windows",
    f"WITH {TRANSITIONS} SELECT clip_id, sample_id, \"current\", array_to_string([g for g in range(\"current\" - 2, \"current\" + 1)], ',') AS context_grid, array_to_string(context_native, ',') AS context_native, target_grid, target_native FROM transitions",
)
def grid_windows(spark, sf_dir):
    return T.transitions(spark, sf_dir).withColumns({"context_grid": joined("context_grid"), "context_native": joined("context_native")})


@query(
    "start_windows",
    f"""WITH {GRID}, s AS (SELECT *, unnest(range(0, n_grid - 3, 2)) AS cur FROM grid)
SELECT clip_id, cur AS "current", (cur + 3) * st AS target_native FROM s WHERE (cur + 3) * st < num_frames""",
)
def start_windows(spark, sf_dir):
    return windows.grid_windows(T.clips(spark, sf_dir), context=3, horizon=1, stride=2, anchor="start").select("clip_id", "current", "target_native")


@query(
    "adaptive_windows",
    f"""WITH {CLIPS}, d AS (SELECT *, num_frames / fps AS dur, CASE WHEN num_frames / fps < 3.0 THEN 0.5 WHEN num_frames / fps < 4.0 THEN 0.75 ELSE 1.0 END AS first FROM clips WHERE num_frames >= 4),
tiers AS (SELECT d.*, t.t, greatest(1, CAST(round_even(t.t * fps, 0) AS INT)) AS df FROM d, (VALUES (1.0::DOUBLE), (0.75), (0.5)) t(t) WHERE t.t <= first),
fit AS (SELECT * FROM tiers WHERE num_frames - 1 >= 3 * df QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY t DESC) = 1),
s AS (SELECT *, unnest(range(0, num_frames - 3 * df, 2 * df)[1:7]) AS start FROM fit)
SELECT clip_id, t AS delta_s, df AS delta_frames, start, array_to_string([start, start + df, start + 2 * df, start + 3 * df], ',') AS frame_indices FROM s""",
)
def adaptive_windows(spark, sf_dir):
    found = windows.adaptive_windows(T.clips(spark, sf_dir))
    return found.select("clip_id", "delta_s", "delta_frames", "start", joined("frame_indices").alias("frame_indices"))


@query(
    "context_lists",
    f"""WITH {FRAMES}, c AS (SELECT clip_id, frame, list(event_type) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS context FROM frames)
SELECT clip_id, frame, array_to_string(context, ',') AS context FROM c WHERE len(context) = 3""",
)
def context_lists(spark, sf_dir):
    return windows.context_lists(T.frames(spark, sf_dir), "clip_id", ["frame"], "event_type").select("clip_id", "frame", joined("context").alias("context"))


@query("latest_wins", "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id, event_type")
def latest_wins(spark, sf_dir):
    return windows.latest(T.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query(
    "diagonal_moves",
    f"""WITH {FRAMES}, p AS (SELECT clip_id, frame, (event_id % 3) AS x, (event_id // 3 % 2) AS y FROM frames), m AS (SELECT clip_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY clip_id ORDER BY frame))
SELECT clip_id, coalesce(bool_or(dx <> 0 AND dy <> 0), false) AS diagonal FROM m GROUP BY clip_id""",
)
def diagonal_moves(spark, sf_dir):
    points = T.frames(spark, sf_dir).select("clip_id", "frame", (F.col("event_id") % 3).alias("x"), (F.floor(F.col("event_id") / 3) % 2).alias("y"))
    return windows.has_diagonal_move(points, "clip_id", "frame")


@query("needed_frames", f"WITH {TRANSITIONS} SELECT DISTINCT clip_id, frame FROM (SELECT clip_id, unnest(list_concat(context_native, [target_native])) AS frame FROM transitions)")
def needed_frames(spark, sf_dir):
    return reports.needed_frames(T.transitions(spark, sf_dir), "clip_id", "context_native", "target_native")


# -- mining -------------------------------------------------------------------


@query(
    "narration_match",
    f"""WITH {TRANSITIONS}, {FRAMES}, seg AS (SELECT clip_id, frame AS a, frame + 7 AS b, event_type AS text, event_id AS segment_id FROM frames WHERE frame % 5 = 0),
m AS (SELECT t.clip_id, sample_id, text, segment_id, a, least(target_native, b) - greatest(context_native[3], a) AS overlap FROM transitions t JOIN seg USING (clip_id))
SELECT clip_id, sample_id, text AS action_text, segment_id FROM m WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY overlap DESC, a, segment_id) = 1""",
)
def narration_match(spark, sf_dir):
    moves = T.transitions(spark, sf_dir).withColumn("last_native", F.element_at("context_native", -1))
    return mining.match_intervals(moves, T.segments(spark, sf_dir), "last_native", "target_native").select("clip_id", "sample_id", "action_text", "segment_id")


@query("narration_match_buckets", ORACLES["narration_match"])
def narration_match_buckets(spark, sf_dir):
    moves = T.transitions(spark, sf_dir).withColumn("last_native", F.element_at("context_native", -1))
    return mining.match_intervals(moves, T.segments(spark, sf_dir), "last_native", "target_native", width=16).select("clip_id", "sample_id", "action_text", "segment_id")


@query("hard_negatives", f"WITH {NEGATIVES} SELECT sample_id, near, mid, far FROM negatives")
def hard_negatives(spark, sf_dir):
    return mining.hard_negatives(T.transitions(spark, sf_dir)).select("sample_id", "near", "mid", "far")


@query(
    "anchors",
    f"WITH {ANCHORS} SELECT example_id, array_to_string(ctx, ',') AS context_paths, array_to_string(cands, ',') AS candidate_paths, array_to_string(kinds, ',') AS candidate_types, answer_index FROM anchors",
)
def anchors(spark, sf_dir):
    return T.anchors(spark, sf_dir).select("example_id", *[joined(c).alias(c) for c in ("context_paths", "candidate_paths", "candidate_types")], "answer_index")


@query(
    "anchors_capped",
    f"""WITH {ANCHORS}, r AS (SELECT example_id, clip_id, answer_index, md5('7:' || example_id || ':sample') AS h FROM anchors), p AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY h, example_id) > 3 AS over FROM r)
SELECT example_id, clip_id, answer_index FROM p ORDER BY over, h, example_id LIMIT 200""",
)
def anchors_capped(spark, sf_dir):
    return splits.capped_sample(T.anchors(spark, sf_dir), "clip_id", "example_id", 200, 3, seed=7).select("example_id", "clip_id", "answer_index")


@query("sound_answers", f"WITH {ANCHORS} SELECT count(*) AS n_bad FROM anchors WHERE kinds[answer_index + 1] <> 'ground_truth'")
def sound_answers(spark, sf_dir):
    return rows.sound_answers(T.anchors(spark, sf_dir)).agg(F.count("*").alias("n_bad"))


@query(
    "ring_distractors",
    """WITH r AS (SELECT doc_id, source, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY md5('0:' || doc_id || ':ring'), doc_id))
SELECT a.doc_id, a.source, b.doc_id AS d1, c.doc_id AS d2, d.doc_id AS d3 FROM r a JOIN r b ON a.source = b.source AND b.i = (a.i + 1) % a.n JOIN r c ON a.source = c.source AND c.i = (a.i + 2) % a.n JOIN r d ON a.source = d.source AND d.i = (a.i + 3) % a.n WHERE a.n > 3""",
)
def ring_distractors(spark, sf_dir):
    found = mining.ring_neighbours(T.table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id")
    return found.select("doc_id", "source", *[F.col("others")[j].alias(f"d{j + 1}") for j in range(3)])


@query(
    "other_clip_negatives",
    """WITH r AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5('0:' || source || ':clip'), source, md5('0:' || doc_id || ':row'), doc_id) - 1 AS i, count(*) OVER () AS n, count(*) OVER (PARTITION BY source) AS block FROM documents),
e AS (SELECT *, max(i) OVER (PARTITION BY source) AS last FROM r)
SELECT a.doc_id, x.doc_id AS o1, y.doc_id AS o2, z.doc_id AS o3 FROM e a LEFT JOIN r x ON x.i = (a.last + 1) % a.n AND a.n - a.block >= 3 LEFT JOIN r y ON y.i = (a.last + 2) % a.n AND a.n - a.block >= 3 LEFT JOIN r z ON z.i = (a.last + 3) % a.n AND a.n - a.block >= 3""",
)
def other_clip_negatives(spark, sf_dir):
    found = mining.other_clip_negatives(T.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")
    return found.select("doc_id", *[F.get("others", F.lit(j)).alias(f"o{j + 1}") for j in range(3)])


@query(
    "negatives_with_fallback",
    f"""WITH {NEGATIVES}, ring AS (SELECT sample_id, clip_id, target_native, row_number() OVER (ORDER BY md5('0:' || clip_id || ':clip'), clip_id, md5('0:' || sample_id || ':row'), sample_id) - 1 AS i, count(*) OVER () AS n, count(*) OVER (PARTITION BY clip_id) AS block FROM transitions),
ends AS (SELECT *, max(i) OVER (PARTITION BY clip_id) AS last FROM ring),
crossed AS (SELECT e.sample_id, string_agg(r.target_native, ',' ORDER BY s.step) AS negatives FROM ends e, (VALUES (1), (2), (3)) s(step), ring r WHERE e.n - e.block >= 3 AND r.i = (e.last + s.step) % e.n AND e.sample_id NOT IN (SELECT sample_id FROM negatives) GROUP BY e.sample_id)
SELECT sample_id, 'same_clip' AS negative_kind, near || ',' || mid || ',' || far AS negatives FROM negatives UNION ALL SELECT sample_id, 'other_clip', negatives FROM crossed""",
)
def negatives_with_fallback(spark, sf_dir):
    return mining.negatives_with_fallback(T.transitions(spark, sf_dir)).select("sample_id", "negative_kind", joined("negatives").alias("negatives"))


# -- splits and samples ----------------------------------------------------------


@query(
    "holdout_count",
    """WITH g AS (SELECT user_id, row_number() OVER (ORDER BY md5('0:' || user_id || ':holdout'), user_id) <= 20 AS held_out FROM (SELECT DISTINCT user_id FROM events))
SELECT held_out, count(*) AS n, count(DISTINCT user_id) AS n_groups FROM events JOIN g USING (user_id) GROUP BY held_out""",
)
def holdout_count(spark, sf_dir):
    return splits.holdout(T.table(spark, sf_dir, "events"), "user_id", count=20).groupBy("held_out").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_groups"))


@query(
    "holdout_fraction",
    """WITH d AS (SELECT DISTINCT conv_id FROM conversations), g AS (SELECT conv_id, row_number() OVER (ORDER BY md5('0:' || conv_id || ':holdout'), conv_id) <= (SELECT greatest(1, CAST(round_even(0.15 * count(*), 0) AS INT)) FROM d) AS held_out FROM d)
SELECT conv_id, held_out FROM g""",
)
def holdout_fraction(spark, sf_dir):
    return splits.holdout(T.table(spark, sf_dir, "conversations").select("conv_id").distinct(), "conv_id", fraction=0.15)


@query("holdout_per_task", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id || ':holdout'), doc_id) <= 5 AS held_out FROM documents")
def holdout_per_task(spark, sf_dir):
    return splits.holdout(T.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", count=5, within=["source"])


@query("disjoint_splits", "SELECT 0 AS shared")
def disjoint_splits(spark, sf_dir):
    marked = splits.holdout(T.table(spark, sf_dir, "events"), "user_id", count=20)
    return splits.require_disjoint(marked.filter("not held_out"), marked.filter("held_out"), "user_id").select("shared")


@query(
    "capped_sample",
    """WITH r AS (SELECT doc_id, source, md5('3:' || doc_id || ':sample') AS h FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) > 4 AS over FROM r)
SELECT doc_id, source FROM p ORDER BY over, h, doc_id LIMIT 120""",
)
def capped_sample(spark, sf_dir):
    return splits.capped_sample(T.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 120, 4, seed=3)


@query("uniform_sample", "SELECT doc_id FROM documents ORDER BY md5('0:' || doc_id || ':sample'), doc_id LIMIT 150")
def uniform_sample(spark, sf_dir):
    return splits.uniform_sample(T.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 150)


@query("first_of_each", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) <= 5")
def first_of_each(spark, sf_dir):
    items = T.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return splits.first_of_each(items, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 5).drop("l_partkey")


PICKS = """picks AS (SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN source = 'src2' THEN md5('9:' || doc_id || ':pick') ELSE md5('0:' || doc_id || ':pick') END, doc_id) <= CASE WHEN source = 'src1' THEN 2 ELSE 4 END)"""


@query("shared_picks", f"WITH {PICKS} SELECT doc_id, source FROM picks")
def shared_picks(spark, sf_dir):
    return splits.shared_picks(T.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 4, {"src1": 2}, {"src2": 9})


@query(
    "extra_picks",
    f"WITH {PICKS} SELECT doc_id, source FROM (SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM picks)) QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('1:' || doc_id || ':pick'), doc_id) <= 3",
)
def extra_picks(spark, sf_dir):
    return splits.extra_picks(T.table(spark, sf_dir, "documents").select("doc_id", "source"), shared_picks(spark, sf_dir), "source", "doc_id", 3)


@query("stride_batch", "SELECT item_id, ['a', 'b', 'c'][((i - 5) // 10) % 3 + 1] AS variant FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark) WHERE i >= 5 AND (i - 5) % 10 = 0")
def stride_batch(spark, sf_dir):
    return splits.stride_batch(T.table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"], 5, 10, ["a", "b", "c"])


@query("chunk_plan", "SELECT CAST(i AS INT) AS chunk, 300000 + i AS seed, CAST(least(500, 11250 - i * 500) AS INT) AS samples FROM range(0, 23) t(i)")
def chunk_plan(spark, sf_dir):
    return splits.chunk_plan(spark, 11250, 500, seed=3)


@query("drawn_direction", "SELECT doc_id, CASE WHEN substring(md5('0:' || doc_id || ':direction'), 1, 1) < '8' THEN 'backward' ELSE 'forward' END AS direction FROM documents")
def drawn_direction(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", rows.direction("mixed", "doc_id").alias("direction"))


# -- rows -------------------------------------------------------------------------

BLOCK = "repeat('<image>' || chr(10), 3)"


@query(
    "generation_rows",
    f"""WITH {ANCHORS}, w AS (SELECT *, substring(md5('0:' || example_id || ':direction'), 1, 1) < '8' AS back, cands[answer_index + 1] AS t FROM anchors)
SELECT example_id, CASE WHEN back THEN 'backward' ELSE 'forward' END AS direction, array_to_string(CASE WHEN back THEN list_append(ctx[2:3], t) ELSE ctx END, ',') AS image, CASE WHEN back THEN ctx[1] ELSE t END AS target_image, CASE WHEN back THEN ctx[2] ELSE ctx[3] END AS cond_image, true AS has_caption,
{BLOCK} || 'Video description: ' || action_text || chr(10) || chr(10) || 'These are 3 consecutive frames from a real-world video' || CASE WHEN back THEN ', occurring immediately AFTER the frame you must predict. Based on the direction and rate of motion established across them, predict the frame that occurred immediately BEFORE the first frame shown.' ELSE '. Observe these frames and produce the next frame of the video.' END AS human,
CASE WHEN back THEN 'The preceding frame should look like this: <img>' ELSE 'The next frame should look like this: <img>' END AS answer FROM w""",
)
def generation_rows(spark, sf_dir):
    found = rows.generation_rows(T.anchors(spark, sf_dir), caption="action_text")
    return _turns(found).select("example_id", "direction", joined("image").alias("image"), "target_image", "cond_image", "has_caption", "human", "answer")


def _turns(found: DataFrame) -> DataFrame:
    turn = lambda k: F.element_at("conversations", k)["value"]
    return found.withColumns({"human": turn(1), "answer": turn(2)})


SELECTION = """'Frame 1: <image>' || chr(10) || 'Frame 2: <image>' || chr(10) || 'Frame 3: <image>' || chr(10) || 'These are 3 consecutive first-person camera frames from an egocentric kitchen video, in order.' || chr(10) || 'Action being performed after the last frame: ' || action_text || chr(10) || 'Option A: <image>' || chr(10) || 'Option B: <image>' || chr(10) || 'Option C: <image>' || chr(10) || 'Option D: <image>' || chr(10) || 'Which option is the true next frame? Answer with a single letter (A, B, C, D).'"""


@query("selection_rows", f"WITH {ANCHORS} SELECT example_id, array_to_string(list_concat(ctx, cands), ',') AS image, {SELECTION} AS human, chr(CAST(65 + answer_index AS INT)) AS answer FROM anchors")
def selection_rows(spark, sf_dir):
    return _turns(rows.selection_rows(T.anchors(spark, sf_dir), with_action=True)).select("example_id", joined("image").alias("image"), "human", "answer")


@query("dual_rows", f"WITH {ANCHORS} SELECT example_id, cands[answer_index + 1] AS target_image, ctx[3] AS cond_image, '0,0,0,1,1,1,1' AS is_option, chr(CAST(65 + answer_index AS INT)) AS answer, false AS eval_holdout FROM anchors")
def dual_rows(spark, sf_dir):
    found = rows.dual_rows(rows.selection_rows(T.anchors(spark, sf_dir)), separate=False)  # strides may be shorter than a context
    return _turns(found).select("example_id", "target_image", "cond_image", joined("is_option").alias("is_option"), "answer", "eval_holdout")


@query(
    "action_rows",
    f"WITH {ANCHORS} SELECT example_id, {BLOCK} || 'These are 3 consecutive first-person camera frames from an egocentric kitchen video. Action being performed after the last frame: ' || action_text || chr(10) || 'Observe these frames and, given the action, produce the next frame of the video.' AS human, cands[answer_index + 1] AS target_image FROM anchors",
)
def action_rows(spark, sf_dir):
    return _turns(rows.action_rows(T.anchors(spark, sf_dir))).select("example_id", "human", "target_image")


@query(
    "edit_rows",
    f"WITH {ANCHORS} SELECT example_id, ctx[3] AS image, '<image>' || chr(10) || 'This image is a single frame captured by a forward-facing camera. Apply the following camera action to it: ' || action_text || chr(10) || 'Edit the image to depict what the camera would see immediately after performing this action, keeping the same scene but updating the viewpoint accordingly.' AS human FROM anchors",
)
def edit_rows(spark, sf_dir):
    return _turns(rows.edit_rows(T.anchors(spark, sf_dir))).select("example_id", joined("image").alias("image"), "human")


def _captioned(spark, sf_dir):
    found = T.anchors(spark, sf_dir)
    return found.select(F.col("example_id").alias("id"), F.lit("kitchen").alias("source"), F.col("context_paths").alias("image"), F.col("candidate_paths")[F.col("answer_index")].alias("target_image"), F.concat(F.lit("  Action: "), F.col("action_text"), F.lit(" ")).alias("caption_prefix"))


@query(
    "progression_rows",
    f"""WITH {ANCHORS} SELECT example_id AS id, {BLOCK} || 'Action: ' || action_text || chr(10) || chr(10) || 'You are shown three consecutive frames, in temporal order. First, in 1-2 sentences (no more than about 40 words), describe how the scene changes across them, based only on what is visible in these three frames. Then, prefaced with "Next frame prediction:", predict in 1-2 sentences (no more than about 40 words) what the next frame will look like.' AS human FROM anchors""",
)
def progression_rows(spark, sf_dir):
    return _turns(rows.progression_skeleton(_captioned(spark, sf_dir))).select("id", "human")


@query("labelling_manifest", f"WITH {ANCHORS} SELECT example_id AS id, 'Context: Action: ' || action_text || '. First' AS context, 4 AS n_images FROM anchors")
def labelling_manifest(spark, sf_dir):
    found = rows.labelling_manifest(_captioned(spark, sf_dir))
    return found.select("id", F.regexp_extract("vlm_prompt", "(?s)Context: .*?[.] First", 0).alias("context"), F.size("vlm_images").alias("n_images"))


# -- joins, merges, filters ---------------------------------------------------------


@query(
    "caption_lookup",
    """WITH k AS (SELECT conv_id, list(role ORDER BY turn) AS roles, arg_max(text, turn) AS caption FROM conversations GROUP BY conv_id), b AS (SELECT roles, arg_max(caption, conv_id) AS caption FROM k WHERE conv_id % 3 <> 0 GROUP BY roles)
SELECT conv_id, array_to_string(roles, ',') AS roles, md5(b.caption) AS caption_md5 FROM k LEFT JOIN b USING (roles)""",
)
def caption_lookup(spark, sf_dir):
    talks = T.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.max_by("text", "turn").alias("caption"))
    talks = talks.select("conv_id", F.transform("t", lambda s: s["role"]).alias("roles"), "caption")
    found = joins.lookup(talks.select("conv_id", "roles"), talks.filter("conv_id % 3 <> 0").select("roles", "caption", "conv_id").withColumnRenamed("conv_id", "place"), ["roles"], ordinal="place", missing="keep")
    return found.select("conv_id", joined("roles").alias("roles"), F.md5("caption").alias("caption_md5"))


@query("label_join", "SELECT d.doc_id, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1")
def label_join(spark, sf_dir):
    return _labelled(spark, sf_dir)[0].select("doc_id", "quality")


def _labelled(spark, sf_dir):
    labels = T.table(spark, sf_dir, "labels").select("doc_id", "quality", (F.col("quality") == 1).alias("ok"), F.lit(0).alias("place"))
    return joins.split_by_label(T.table(spark, sf_dir, "documents").select("doc_id", "source"), labels, "doc_id", "ok", "place")


@query("dropped_ids", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(quality, 0) <> 1")
def dropped_ids(spark, sf_dir):
    return _labelled(spark, sf_dir)[1]


@query(
    "merge_sources",
    """SELECT 'mix_' || lpad(CAST(row_number() OVER (ORDER BY source NULLS LAST, doc_id) - 1 AS VARCHAR), 6, '0') AS id, CAST(doc_id AS VARCHAR) AS orig_id, source, lang FROM documents""",
)
def merge_sources(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("place"), "source", "lang")
    return sets.merge_tagged(docs, F.col("source").asc_nulls_last(), "place", "mix").select("id", "orig_id", "source", "lang")


PATHS = """top AS (SELECT max(doc_id) + 1 AS n FROM documents), r AS (SELECT conv_id, CAST(conv_id * 7 % n AS VARCHAR) AS p1, CAST(conv_id * 13 % n AS VARCHAR) AS p2, CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id % n AS VARCHAR) END AS p3 FROM (SELECT DISTINCT conv_id FROM conversations), top), e AS (SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 5 <> 0),
kept AS (SELECT conv_id FROM r WHERE p1 IN (SELECT path FROM e) AND p2 IN (SELECT path FROM e) AND (p3 IS NULL OR p3 IN (SELECT path FROM e)))"""


def _id_range(spark, sf_dir):
    """One more than the greatest doc_id."""
    return (T.table(spark, sf_dir, "documents").agg(F.max("doc_id").alias("top")).first()["top"] or 0) + 1


def _paths(spark, sf_dir):
    talks = T.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    number = lambda c: c.cast("string")
    n = _id_range(spark, sf_dir)
    found = talks.select("conv_id", (F.col("conv_id") % 4).alias("source"), F.array(number(F.col("conv_id") * 7 % n), number(F.col("conv_id") * 13 % n)).alias("image"), F.when(F.col("conv_id") % 2 == 0, number(F.col("conv_id") % n)).alias("cond_image"))
    existing = T.table(spark, sf_dir, "documents").filter("doc_id % 5 <> 0").select(number(F.col("doc_id")).alias("path"))
    return found, joins.drop_missing_paths(found, "conv_id", ["image", "cond_image"], existing)


@query("missing_paths", f"WITH {PATHS} SELECT conv_id FROM kept")
def missing_paths(spark, sf_dir):
    return _paths(spark, sf_dir)[1].select("conv_id")


@query("missing_path_counts", f"WITH {PATHS} SELECT conv_id % 4 AS source, count(*) FILTER (WHERE conv_id IN (SELECT conv_id FROM kept)) AS n_kept, count(*) FILTER (WHERE conv_id NOT IN (SELECT conv_id FROM kept)) AS n_dropped FROM r GROUP BY 1")
def missing_path_counts(spark, sf_dir):
    before, after = _paths(spark, sf_dir)
    return joins.drop_counts(before, after, "source")


@query("fresh_candidates", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def fresh_candidates(spark, sf_dir):
    labels = T.table(spark, sf_dir, "labels")
    return joins.fresh_candidates(T.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", labels.filter("quality = 1"), labels.filter("toxic = 1"))


@query("resume", f"WITH {SCORES} SELECT id FROM scores WHERE judge_score IS NULL")
def resume(spark, sf_dir):
    found = T.scores(spark, sf_dir)
    return joins.to_resume(found.select("id"), found.select("id", "judge_score"), "id", "judge_score")


@query("canonical_fallback", "SELECT d.doc_id, coalesce(l.quality, CAST(d.doc_id % 2 AS INT)) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def canonical_fallback(spark, sf_dir):
    docs, labels = T.table(spark, sf_dir, "documents").select("doc_id"), T.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return joins.lookup(docs, labels, ["doc_id"], missing="fallback", fallback={"quality": (F.col("doc_id") % 2).cast("int")})


@query("in_every_system", f"WITH {SCORES} SELECT id FROM scores WHERE rule_score IS NOT NULL AND judge_score IS NOT NULL")
def in_every_system(spark, sf_dir):
    found = T.scores(spark, sf_dir)
    long = found.select("id", F.lit("rule").alias("system"), F.col("rule_score").alias("score")).union(found.select("id", F.lit("judge"), "judge_score"))
    return joins.in_every_system(long, ["id"], "system", 2)


@query("combine_scores", f"WITH {SCORES} SELECT run, id, rule_score, judge_score, task_name FROM scores WHERE rule_score IS NOT NULL AND judge_score IS NOT NULL")
def combine_scores(spark, sf_dir):
    found = T.scores(spark, sf_dir)
    return joins.combine_scores(found.select("run", "id", "rule_score"), found.select("run", "id", "judge_score"), found.select("run", "id", "task_name"), ["run", "id"])


@query("judge_by_task", f"WITH {SCORES} SELECT id, CASE WHEN task_name = 'src3' THEN 'yes_no' ELSE 'rubric' END AS judge, CASE WHEN task_name = 'src3' THEN rule_score ELSE judge_score END AS score FROM scores")
def judge_by_task(spark, sf_dir):
    found = T.scores(spark, sf_dir)
    rubric = found.select("id", "task_name", F.lit("rubric").alias("judge"), F.col("judge_score").alias("score"))
    yes_no = found.select("id", "task_name", F.lit("yes_no").alias("judge"), F.col("rule_score").alias("score"))
    return joins.judge_by_task(rubric, yes_no, "task_name", ["src3"]).drop("task_name")


@query(
    "shifted_pairs",
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT a.doc_id, a.source, b.doc_id AS other FROM r a JOIN r b ON a.source = b.source AND b.i = (a.i + 2) % a.n""",
)
def shifted_pairs(spark, sf_dir):
    return joins.shifted_pairs(T.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 2)


@query("merge_shards", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS shard_value FROM documents")
def merge_shards(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("place"))
    return sets.merge_shards([docs.withColumn("shard_value", F.lit(0)), docs.filter("doc_id % 2 = 0").withColumn("shard_value", F.lit(1))], "doc_id", "place").select("doc_id", "shard_value")


@query("distinct_signature", "SELECT min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, CAST(round_even(p_size / 5.0, 0) AS INT), CAST(round_even(p_retailprice / 100.0, 0) AS BIGINT)")
def distinct_signature(spark, sf_dir):
    signature = F.concat_ws("|", "p_brand", F.bround(F.col("p_size") / 5.0).cast("int").cast("string"), F.bround(F.col("p_retailprice") / 100.0).cast("long").cast("string"))
    return sets.distinct_by(T.table(spark, sf_dir, "part"), signature, "p_partkey").select("p_partkey")


@query(
    "unused_combinations",
    "SELECT s.s AS p_size, n.n_nationkey FROM (SELECT unnest(range(1, 51)) AS s) s, nation n WHERE NOT EXISTS (SELECT 1 FROM part, supplier WHERE p_partkey = s_suppkey AND p_size = s.s AND s_nationkey = n.n_nationkey)",
)
def unused_combinations(spark, sf_dir):
    used = T.table(spark, sf_dir, "part").join(T.table(spark, sf_dir, "supplier"), F.col("p_partkey") == F.col("s_suppkey")).select("p_size", F.col("s_nationkey").alias("n_nationkey"))
    sizes = spark.range(1, 51).select(F.col("id").cast("int").alias("p_size"))
    return sets.unused_combinations(used, sizes, T.table(spark, sf_dir, "nation").select("n_nationkey"))


# -- reports ------------------------------------------------------------------------


@query("count_by_source", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark, sf_dir):
    return reports.count_by(T.table(spark, sf_dir, "documents"), "source")


@query(
    "task_summary",
    f"WITH {SCORES} SELECT task_name, count(*) AS n, count(rule_score) AS n_scored, round(avg(rule_score), 9) AS mean_score, min(rule_score) AS min_score, max(rule_score) AS max_score, task_name IS NULL AS is_total FROM scores GROUP BY ROLLUP (task_name)",
)
def task_summary(spark, sf_dir):
    return reports.summary(T.scores(spark, sf_dir), score="rule_score").withColumn("mean_score", F.round("mean_score", 9))


BOTH = "rule_score IS NOT NULL AND judge_score IS NOT NULL"


@query(
    "model_means",
    f"WITH {SCORES} SELECT run, task_name, count(*) FILTER (WHERE {BOTH}) AS n, round(coalesce(avg(rule_score) FILTER (WHERE {BOTH}), 0), 9) AS mean_rule, round(coalesce(avg(judge_score) FILTER (WHERE {BOTH}), 0), 9) AS mean_judge FROM scores GROUP BY run, task_name",
)
def model_means(spark, sf_dir):
    return reports.model_means(T.scores(spark, sf_dir), ["run", "task_name"]).withColumns({c: F.round(c, 9) for c in ("mean_rule", "mean_judge")})


@query(
    "subset_means",
    f"WITH {SCORES}, s AS (SELECT *, CASE WHEN id % 7 = 0 THEN (id % 13) / 12.0::DOUBLE END AS third FROM scores) SELECT task_name, count(third) AS n_subset, round(avg(rule_score) FILTER (WHERE third IS NOT NULL), 9) AS rule_subset, round(avg(judge_score) FILTER (WHERE third IS NOT NULL), 9) AS judge_subset, round(avg(third), 9) AS third_subset FROM s GROUP BY task_name",
)
def subset_means(spark, sf_dir):
    found = T.scores(spark, sf_dir).withColumn("third", F.when(F.col("id") % 7 == 0, (F.col("id") % 13) / 12.0))
    return reports.subset_means(found, ["task_name"], "third").withColumns({c: F.round(c, 9) for c in ("rule_subset", "judge_subset", "third_subset")})


@query(
    "weighted_domain_mean",
    f"WITH {SCORES}, t AS (SELECT domain, task_name, count(*) AS n, avg(CASE WHEN task_name <> 'src4' THEN rule_score END) AS m FROM scores GROUP BY 1, 2) SELECT domain, round(sum(coalesce(m, 0) * n) / sum(n), 9) AS weighted_mean FROM t GROUP BY domain",
)
def weighted_domain_mean(spark, sf_dir):
    tasks = T.scores(spark, sf_dir).groupBy("domain", "task_name").agg(F.count("*").alias("n"), F.avg(F.when(F.col("task_name") != "src4", F.col("rule_score"))).alias("mean_score"))
    return reports.weighted_domain_mean(tasks, "domain").withColumn("weighted_mean", F.round("weighted_mean", 9))


@query(
    "distribution",
    f"WITH {SCORES} SELECT run, round(avg(rule_score), 9) AS mean, round(stddev_pop(rule_score), 9) AS sd, min(rule_score) AS low, max(rule_score) AS high, count(*) FILTER (WHERE rule_score < 0.5) AS below_half FROM scores GROUP BY run",
)
def distribution(spark, sf_dir):
    return reports.distribution(T.scores(spark, sf_dir), ["run"], "rule_score").withColumns({c: F.round(c, 9) for c in ("mean", "sd")})


@query(
    "level_counts",
    f"WITH {SCORES}, m AS (SELECT domain, run, avg(judge_score) AS m FROM scores GROUP BY 1, 2) SELECT domain, count(DISTINCT round(judge_score, 4)) AS levels, (SELECT round(max(m) - min(m), 9) FROM m WHERE m.domain = s.domain) AS spread FROM scores s GROUP BY domain",
)
def level_counts(spark, sf_dir):
    return reports.level_counts(T.scores(spark, sf_dir), "domain", "run", "judge_score").withColumn("spread", F.round("spread", 9))


@query("histogram", f"WITH {SCORES} SELECT run, round(judge_score, 3) AS value, count(*) AS n FROM scores WHERE judge_score IS NOT NULL GROUP BY 1, 2")
def histogram(spark, sf_dir):
    return reports.histogram(T.scores(spark, sf_dir), ["run"], "judge_score")


@query(
    "no_counts",
    """WITH a AS (SELECT source, unnest([{'question': 'long', 'yes': n_chars > 1500}, {'question': 'even', 'yes': doc_id % 2 = 0}, {'question': 'english', 'yes': lang = 'en'}], recursive := true) FROM documents) SELECT source, question, count(*) FILTER (WHERE NOT yes) AS n_no, count(yes) AS n_answers FROM a GROUP BY 1, 2""",
)
def no_counts(spark, sf_dir):
    answers = F.create_map(F.lit("long"), F.col("n_chars") > 1500, F.lit("even"), F.col("doc_id") % 2 == 0, F.lit("english"), F.col("lang") == "en")
    return reports.no_counts(T.table(spark, sf_dir, "documents").withColumn("answers", answers), ["source"], "answers")


@query(
    "discrimination",
    f"WITH {SCORES}, s AS (SELECT *, id % 4 = 0 AS ok FROM scores) SELECT run, round(avg(rule_score) FILTER (WHERE ok), 9) AS mean_correct, round(avg(rule_score) FILTER (WHERE NOT ok), 9) AS mean_wrong, round(avg(rule_score) FILTER (WHERE ok) - avg(rule_score) FILTER (WHERE NOT ok), 9) AS gap, round(avg(CASE WHEN abs(rule_score - judge_score) < 1e-6 THEN 1.0 WHEN abs(rule_score - judge_score) >= 1e-6 THEN 0.0 END), 9) AS exact_rate FROM s GROUP BY run",
)
def discrimination(spark, sf_dir):
    found = T.scores(spark, sf_dir).withColumn("ok", F.col("id") % 4 == 0)
    out = reports.discrimination(found, ["run"], "rule_score", "ok", "judge_score")
    return out.withColumns({c: F.round(c, 9) for c in out.columns[1:]})


@query(
    "sampling_stats",
    ORACLES["adaptive_windows"].replace("SELECT clip_id, t AS delta_s", ", w AS (SELECT clip_id, t AS delta_s").replace(" FROM s", " FROM s)", 1)
    + """ SELECT c.clip_id % 4 AS pool, count(*) AS available, count(n) AS eligible, count(*) - count(n) AS too_short, coalesce(sum(n), 0)::BIGINT AS n_windows, array_to_string(list_sort(list(DISTINCT d) FILTER (WHERE d IS NOT NULL)), ',') AS spacings, coalesce(sum(n), 0) < 100 AS shortfall
FROM clips c LEFT JOIN (SELECT clip_id, count(*) AS n, any_value(delta_s) AS d FROM w GROUP BY clip_id) p ON c.clip_id = p.clip_id GROUP BY 1""",
)
def sampling_stats(spark, sf_dir):
    pool = F.col("clip_id") % 4
    clips = T.clips(spark, sf_dir).withColumn("pool", pool)
    found = reports.sampling_stats(clips, windows.adaptive_windows(clips), ["pool"], 100)
    return found.withColumn("spacings", joined("spacings"))


@query(
    "gap_stats",
    f"WITH {SCORES}, g AS (SELECT *, judge_score - rule_score AS gap FROM scores WHERE {BOTH}) SELECT run, round(avg(abs(gap)), 9) AS mean_gap, count(*) FILTER (WHERE abs(gap) >= 0.5) AS n_large, count(*) FILTER (WHERE rule_score = 0) AS n_zero, count(*) FILTER (WHERE rule_score > 0) AS n_positive, first(id ORDER BY gap, id) AS worst FROM g GROUP BY run",
)
def gap_stats(spark, sf_dir):
    return reports.gap_stats(T.scores(spark, sf_dir).filter(BOTH), ["run"], "id").withColumn("mean_gap", F.round("mean_gap", 9))


@query(
    "worst_and_typical",
    f"WITH {SCORES}, s AS (SELECT *, avg(rule_score) OVER (PARTITION BY task_name) AS m FROM scores WHERE rule_score IS NOT NULL), p AS (SELECT task_name, first(id ORDER BY rule_score, id) AS worst, first(id ORDER BY round(abs(rule_score - m), 12), id) AS typical FROM s GROUP BY 1) SELECT task_name, worst, CASE WHEN typical <> worst THEN typical END AS typical FROM p",
)
def worst_and_typical(spark, sf_dir):
    return reports.worst_and_typical(T.scores(spark, sf_dir).filter("rule_score is not null"), ["task_name"], "id", "rule_score")


@query("mean_gap", f"WITH {SCORES} SELECT domain, round(avg(abs(rule_score - judge_score)), 9) AS mae FROM scores GROUP BY domain")
def mean_gap(spark, sf_dir):
    return reports.mean_gap(T.scores(spark, sf_dir), ["domain"], "rule_score", "judge_score").withColumn("mae", F.round("mae", 9))


RANKS = f"""{SCORES}, b AS (SELECT * FROM scores WHERE {BOTH}), ranks AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY rule_score) + (count(*) OVER (PARTITION BY run, rule_score) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY run ORDER BY judge_score) + (count(*) OVER (PARTITION BY run, judge_score) - 1) / 2.0::DOUBLE AS ry FROM b)"""


@query("average_rank", f"WITH {RANKS} SELECT id, run, rx AS rank FROM ranks")
def average_rank(spark, sf_dir):
    return T.scores(spark, sf_dir).filter(BOTH).select("id", "run", S.average_rank("rule_score", "run").alias("rank"))


@query("spearman", f"WITH {RANKS} SELECT run, round(corr(rx, ry), 9) AS spearman FROM ranks GROUP BY run")
def spearman(spark, sf_dir):
    return S.spearman(T.scores(spark, sf_dir), ["run"], "rule_score", "judge_score").withColumn("spearman", F.round("spearman", 9))


@query("pearson", f"WITH {SCORES} SELECT run, round(corr(rule_score, judge_score), 9) AS pearson, CAST(NULL AS DOUBLE) AS flat FROM scores GROUP BY run")
def pearson(spark, sf_dir):
    found = T.scores(spark, sf_dir).withColumn("one", F.lit(1.0))
    return found.groupBy("run").agg(F.round(S.pearson("rule_score", "judge_score"), 9).alias("pearson"), S.pearson("rule_score", "one").alias("flat"))


# -- scalar functions -----------------------------------------------------------------


@query(
    "labelled_parts",
    """WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Progression: it  moves' || chr(10) || ' on ' || doc_id || chr(10) || chr(10) || 'Next frame: it stops!' WHEN 1 THEN 'Progression: alone' WHEN 2 THEN 'Next frame: ' || doc_id || ' only' ELSE 'x Progression:a' || chr(10) || 'Next frame:  b c  ' || chr(10) END AS t FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'it moves on ' || doc_id WHEN 3 THEN 'a' END AS progression, CASE doc_id % 4 WHEN 0 THEN 'it stops!' WHEN 3 THEN 'b c' END AS following, CASE doc_id % 4 WHEN 0 THEN 'it moves on ' || doc_id || '. Next frame prediction: it stops! The next frame should look like this: <img>' WHEN 3 THEN 'a. Next frame prediction: b c. The next frame should look like this: <img>' END AS turn FROM r""",
)
def labelled_parts(spark, sf_dir):
    i = F.col("doc_id")
    response = (
        F.when(i % 4 == 0, P.text("Progression: it  moves\n on ", i, "\n\nNext frame: it stops!"))
        .when(i % 4 == 1, F.lit("Progression: alone"))
        .when(i % 4 == 2, P.text("Next frame: ", i, " only"))
        .otherwise(F.lit("x Progression:a\nNext frame:  b c  \n"))
    )
    first, second = P.labelled_parts(response)
    found = T.table(spark, sf_dir, "documents").select("doc_id", first.alias("progression"), second.alias("following"))
    return found.withColumn("turn", P.answer_turn(F.col("progression"), F.col("following")))


@query(
    "judge_parsing",
    """SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 0.0 ELSE ((CASE doc_id % 2 WHEN 0 THEN 1.0 ELSE 0.5 END) * 60 + (CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) * 40) / 100 END::DOUBLE AS rubric, CASE WHEN doc_id % 5 <> 0 THEN ((doc_id % 2) + quality) / 2.0 END::DOUBLE AS yes_share FROM labels""",
)
def judge_parsing(spark, sf_dir):
    i = F.col("doc_id")
    place = F.when(i % 3 == 2, "superb").otherwise(F.when(i % 2 == 0, " Correct").otherwise("partial"))
    place = F.when(i % 4 < 2, P.text("{\"observation\": \"the {block} moved\", \"level\": \"", place, "\"}")).otherwise(P.text("\"", place, "\""))
    reply = P.text("Sure: {\"criteria\": {\"place\": ", place, ", \"shape\": \"", F.when(F.col("quality") == 1, "correct").otherwise("wrong"), "\"}}")
    votes = P.text("{\"long\": \"", F.when(i % 2 == 1, "Yes").otherwise("no"), "\", \"good\": \"", F.when(i % 5 == 0, "maybe").when(F.col("quality") == 1, "1").otherwise("FALSE"), "\"}")
    levels = F.from_json(S.json_block(reply), "criteria map<string,string>")["criteria"]
    answers = F.from_json(S.json_block(votes), "map<string,string>")
    return T.table(spark, sf_dir, "labels").select("doc_id", F.round(S.rubric_score(levels, {"place": 60.0, "shape": 40.0}), 9).alias("rubric"), S.yes_share(answers, ["long", "good"]).alias("yes_share"))


@query("balanced_json", """SELECT doc_id, '{"a": {"b": ' || doc_id || '}}' AS block FROM documents""")
def balanced_json(spark, sf_dir):
    reply = P.text("well } {\"a\": {\"b\": ", F.col("doc_id"), "}} and (so) } on {")
    return T.table(spark, sf_dir, "documents").select("doc_id", S.balanced_json(reply).alias("block"))


@query(
    "score_ramps",
    """WITH r AS (SELECT doc_id, (doc_id % 101) / 100.0::DOUBLE AS v FROM documents) SELECT doc_id, round(CASE WHEN v <= 0.15 THEN 1.0 WHEN v >= 0.6 THEN 0.0 ELSE 1 - (v - 0.15) / 0.45 END, 9)::DOUBLE AS band, (CASE WHEN v < 0.05 THEN 0.0 WHEN v < 0.15 THEN 0.25 WHEN v < 0.30 THEN 0.6 ELSE 1.0 END)::DOUBLE AS ceiling,
round(CASE WHEN v >= 0.6 THEN 1.0 WHEN v <= 0.15 THEN 0.1 ELSE 0.1 + (v - 0.15) / 0.45 * 0.9 END, 9)::DOUBLE AS gate, round(CASE WHEN v <= 0.1 THEN 1.0 WHEN v >= 0.5 THEN 0.2 ELSE 1 - (v - 0.1) / 0.4 * 0.8 END, 9)::DOUBLE AS penalty FROM r""",
)
def score_ramps(spark, sf_dir):
    n = F.col("doc_id") % 101
    v = n / 100.0
    return T.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.round(S.band(v, 0.15, 0.6), 9).alias("band"),
        S.blankness_ceiling(n.cast("double"), F.lit(100.0)).alias("ceiling"),
        F.round(S.coverage_gate(n, F.lit(100)), 9).alias("gate"),
        F.round(S.off_palette_penalty(v, 0.1, 0.5, 0.2), 9).alias("penalty"),
    )


@query(
    "agreement",
    f"WITH {SCORES}, g AS (SELECT id, judge_score - rule_score AS g FROM scores WHERE {BOTH}) SELECT id, CASE WHEN g >= 0.5 THEN 'judge much higher' WHEN abs(g) >= 0.5 THEN 'judge much lower' WHEN abs(g) >= 0.25 THEN 'disagreement' ELSE 'close agreement' END AS badge FROM g",
)
def agreement(spark, sf_dir):
    return T.scores(spark, sf_dir).filter(BOTH).select("id", S.agreement(F.col("rule_score"), F.col("judge_score")).alias("badge"))


@query(
    "angles",
    """WITH r AS (SELECT doc_id, (doc_id * 37 % 720 - 360)::DOUBLE AS a, (doc_id * 11 % 360)::DOUBLE AS b FROM documents), d AS (SELECT *, (((a - b) % 180) + 180) % 180 AS d FROM r) SELECT doc_id, least(d, 180 - d) AS axial, 180 - ((((180 - a) % 360) + 360) % 360) AS signed FROM d""",
)
def angles(spark, sf_dir):
    a, b = (F.col("doc_id") * 37 % 720 - 360).cast("double"), (F.col("doc_id") * 11 % 360).cast("double")
    return T.table(spark, sf_dir, "documents").select("doc_id", S.axial_difference(a, b).alias("axial"), S.signed_angle(a).alias("signed"))


@query(
    "nearest_colour",
    "WITH names(name, i, r, g, b) AS (VALUES "
    + ", ".join(f"('{n}', {i}, {r}, {g}, {b})" for i, (n, (r, g, b)) in enumerate(P.NAMED_COLOURS.items()))
    + "), c AS (SELECT doc_id, doc_id * 7 % 256 AS x, doc_id * 13 % 256 AS y, doc_id * 29 % 256 AS z FROM documents) SELECT doc_id, arg_min(name, pow(x - r, 2) + pow(y - g, 2) + pow(z - b, 2) + i / 1000.0) AS colour FROM c, names GROUP BY doc_id",
)
def nearest_colour(spark, sf_dir):
    part = lambda k: F.col("doc_id") * k % 256
    return T.table(spark, sf_dir, "documents").select("doc_id", P.nearest_colour(part(7), part(13), part(29)).alias("colour"))


@query(
    "text_rules",
    """SELECT doc_id, trim(regexp_replace(text, '[\\x09-\\x0D\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) AS squeezed, lang || CASE WHEN doc_id % 2 = 0 THEN '!' ELSE '.' END AS ended, CASE WHEN doc_id % 7 BETWEEN 1 AND 5 THEN ['one', 'two', 'three', 'four', 'five'][doc_id % 7] ELSE CAST(doc_id % 7 AS VARCHAR) END AS word, 'clip' || doc_id AS clip, CAST(doc_id % 90 AS INT) AS frame FROM documents""",
)
def text_rules(spark, sf_dir):
    path = P.frame_path("frames", F.concat(F.lit("clip"), F.col("doc_id").cast("string")), F.col("doc_id") % 90)
    clip, frame = P.frame_of(path)
    ended = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("! "))).otherwise(F.col("lang"))
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", P.squeeze(F.col("text")).alias("squeezed"), P.with_period(ended).alias("ended"), P.number_word(F.col("doc_id") % 7).alias("word"), clip.alias("clip"), frame.alias("frame")
    )


@query("parameter_hash", """SELECT p_partkey, substring(sha256('{"brand": "' || p_brand || '", "size": ' || p_size || '}'), 1, 16) AS param_hash FROM part""")
def parameter_hash(spark, sf_dir):
    raw = F.to_json(F.struct(F.col("p_size").alias("size"), F.lit("x").alias("image_temp_path"), F.lit(7).alias("random_seed"), F.col("p_brand").alias("brand")))
    return generators.with_parameter_hash(T.table(spark, sf_dir, "part").select("p_partkey", raw.alias("parameters"))).select("p_partkey", "param_hash")


# -- objects --------------------------------------------------------------------------


@query(
    "palette_gaps",
    f"WITH {OBJECTS} SELECT image_id, idx FROM objects p WHERE role = 'gt' AND NOT EXISTS (SELECT 1 FROM objects q WHERE q.image_id = p.image_id AND q.role = 'cand' AND {DE} <= 25)",
)
def palette_gaps(spark, sf_dir):
    return objects.palette_gaps(T.objects(spark, sf_dir))


@query(
    "object_sources",
    f"WITH {OBJECTS} SELECT p.image_id, p.idx AS gt, q.idx AS src FROM objects p JOIN objects q ON p.image_id = q.image_id AND p.role = 'gt' AND q.role = 'input' QUALIFY row_number() OVER (PARTITION BY p.image_id, p.idx ORDER BY {DE}, q.idx) = 1",
)
def object_sources(spark, sf_dir):
    return objects.sources_of(T.objects(spark, sf_dir)).select("image_id", "gt", F.col("src.idx").alias("src"))


@query(
    "markers_in_place",
    f"WITH {OBJECTS}, ok AS (SELECT DISTINCT p.image_id, p.idx FROM objects p JOIN objects q ON p.image_id = q.image_id AND p.role = 'cand' AND q.role = 'input' WHERE {DE} <= 25 AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 14) SELECT o.image_id, round((SELECT count(*) FROM ok WHERE ok.image_id = o.image_id) / 3.0::DOUBLE, 9) AS star_invariance FROM (SELECT DISTINCT image_id FROM objects) o",
)
def markers_in_place(spark, sf_dir):
    return objects.markers_in_place(T.objects(spark, sf_dir)).withColumn("star_invariance", F.round("star_invariance", 9))


@query(
    "valid_layouts",
    f"WITH {OBJECTS}, r AS (SELECT *, sqrt(area) / 2 * CASE WHEN shape = 'circle' THEN 1 ELSE sqrt(2.0) END AS rad FROM objects WHERE role = 'gt') SELECT image_id AS layout, NOT EXISTS (SELECT 1 FROM r p JOIN r q ON p.image_id = q.image_id AND p.idx < q.idx WHERE p.image_id = o.image_id AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) < p.rad + q.rad + 5) AS valid FROM (SELECT DISTINCT image_id FROM r) o",
)
def valid_layouts(spark, sf_dir):
    items = T.objects(spark, sf_dir).filter("role = 'gt'").select(F.col("image_id").alias("layout"), "idx", "x", "y", (F.sqrt("area") / 2).alias("size"), "shape")
    return objects.valid_layouts(items, 5.0)


@query("largest_object", f"WITH {OBJECTS} SELECT image_id, idx FROM objects WHERE role = 'gt' QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY shape = 'square' DESC, area DESC, idx) = 1")
def largest_object(spark, sf_dir):
    return objects.largest(T.objects(spark, sf_dir).filter("role = 'gt'"), F.col("shape") == "square")


@query("grid_cells", f"WITH {OBJECTS}, r AS (SELECT image_id, idx, x, dense_rank() OVER (PARTITION BY image_id ORDER BY CAST(floor(y / 128) AS INT)) - 1 AS row FROM objects WHERE role = 'gt') SELECT image_id, idx, row, row_number() OVER (PARTITION BY image_id, row ORDER BY x, idx) - 1 AS \"column\" FROM r")
def grid_cells(spark, sf_dir):
    return objects.grid_cells(T.objects(spark, sf_dir).filter("role = 'gt'"), 128.0).select("image_id", "idx", "row", "column")


MATCHED = f"""{OBJECTS}, found AS (SELECT p.image_id, p.idx AS gt, q.idx AS cand, {DE} AS de, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS dist FROM objects p JOIN objects q ON p.image_id = q.image_id AND p.role = 'gt' AND q.role = 'cand'),
priced AS (SELECT *, de + dist AS cost FROM found WHERE de <= 25),
m1 AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY cost, gt, cand) = 1),
m2 AS (SELECT p.* FROM priced p JOIN m1 USING (image_id) WHERE p.gt <> m1.gt AND p.cand <> m1.cand QUALIFY row_number() OVER (PARTITION BY p.image_id ORDER BY p.cost, p.gt, p.cand) = 1),
m3 AS (SELECT p.* FROM priced p JOIN m1 USING (image_id) JOIN m2 USING (image_id) WHERE p.gt NOT IN (m1.gt, m2.gt) AND p.cand NOT IN (m1.cand, m2.cand) QUALIFY row_number() OVER (PARTITION BY p.image_id ORDER BY p.cost, p.gt, p.cand) = 1),
matched AS (SELECT o.image_id, o.idx AS gt, m.cand, m.dist FROM objects o LEFT JOIN (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3) m ON o.image_id = m.image_id AND o.idx = m.gt WHERE o.role = 'gt')"""


@query("greedy_match", f"WITH {MATCHED} SELECT image_id, gt, cand, round(dist, 6) AS dist FROM matched")
def greedy_match(spark, sf_dir):
    return objects.greedy_match(T.objects(spark, sf_dir)).withColumn("dist", F.round("dist", 6))


@query(
    "nearest_per_slot",
    f"""WITH {MATCHED}, near AS (SELECT * FROM found WHERE dist <= 120),
s0 AS (SELECT * FROM near WHERE gt = 0 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY dist, cand) = 1),
s1 AS (SELECT n.* FROM near n LEFT JOIN s0 ON n.image_id = s0.image_id WHERE n.gt = 1 AND n.cand IS DISTINCT FROM s0.cand QUALIFY row_number() OVER (PARTITION BY n.image_id ORDER BY n.dist, n.cand) = 1),
s2 AS (SELECT n.* FROM near n LEFT JOIN s0 ON n.image_id = s0.image_id LEFT JOIN s1 ON n.image_id = s1.image_id WHERE n.gt = 2 AND n.cand IS DISTINCT FROM s0.cand AND n.cand IS DISTINCT FROM s1.cand QUALIFY row_number() OVER (PARTITION BY n.image_id ORDER BY n.dist, n.cand) = 1)
SELECT o.image_id, o.idx AS slot, CAST(p.cand AS BIGINT) AS cand FROM objects o LEFT JOIN (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) p ON o.image_id = p.image_id AND o.idx = p.gt WHERE o.role = 'gt'""",
)
def nearest_per_slot(spark, sf_dir):
    return objects.nearest_per_slot(T.objects(spark, sf_dir), 120.0)


@query(
    "placement_scores",
    f"""WITH {MATCHED}, src AS (SELECT p.image_id, p.idx AS gt, q.area, q.shape, {DE} AS de FROM objects p JOIN objects q ON p.image_id = q.image_id AND p.role = 'gt' AND q.role = 'input' QUALIFY row_number() OVER (PARTITION BY p.image_id, p.idx ORDER BY {DE}, q.idx) = 1),
judged AS (SELECT m.image_id, m.cand, m.dist, sqrt(greatest(1.0, g.area)) AS side, c.shape = s.shape AS alike, s.de, 1 - least(c.area, s.area) / greatest(c.area, s.area, 1.0) AS off FROM matched m JOIN objects g ON g.image_id = m.image_id AND g.role = 'gt' AND g.idx = m.gt LEFT JOIN objects c ON c.image_id = m.image_id AND c.role = 'cand' AND c.idx = m.cand LEFT JOIN src s ON s.image_id = m.image_id AND s.gt = m.gt),
sums AS (SELECT image_id, avg(CASE WHEN dist <= 0.6 * side THEN 1.0 ELSE 0.0 END) AS hit, avg(CASE WHEN dist IS NULL OR dist >= 0.8 * side THEN 0.0 WHEN dist <= 0.2 * side THEN 1.0 ELSE 1 - (dist - 0.2 * side) / (0.6 * side) END) AS align,
  avg(CASE WHEN cand IS NULL OR de > 25 THEN 0.0 ELSE (CASE WHEN alike THEN 0.5 ELSE 0.0 END) + 0.5 * (CASE WHEN off <= 0.15 THEN 1.0 WHEN off >= 0.6 THEN 0.0 ELSE 1 - (off - 0.15) / 0.45 END) END) AS fidelity FROM judged GROUP BY image_id),
stars AS (SELECT p.image_id, CASE WHEN {DE} <= 25 AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 14 THEN 1.0 ELSE 0.0 END AS kept FROM objects p JOIN objects q ON p.image_id = q.image_id AND p.role = 'cand' AND q.role = 'input' AND p.idx = 0 AND q.idx = 0)
SELECT image_id, round(0.375 * hit + 0.3125 * align + 0.1875 * fidelity + 0.125 * kept, 6) AS score FROM sums JOIN stars USING (image_id)""",
)
def placement_scores(spark, sf_dir):
    shapes = T.objects(spark, sf_dir)
    ceilings = shapes.select("image_id").distinct().withColumn("ceiling", F.lit(1.0))
    return objects.placement_scores(shapes, shapes.filter("idx = 0"), ceilings).select("image_id", F.round("score", 6).alias("score"))


# -- generators -----------------------------------------------------------------------


#: As many samples as there are documents, and a draw as a number from low to high.
SAMPLES_ASKED = "n AS (SELECT count(*) AS n FROM documents)"


def _drawn(identity: str, name: str, low: int, high: int) -> str:
    return f"({low} + ('0x' || substring(md5('0:' || {identity} || ':{name}'), 1, 8))::BIGINT % {high - low + 1})"


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


@query(
    "rotation_parameters",
    f"""WITH {SAMPLES_ASKED}, ids AS (SELECT i AS sample, 'rotation_' || lpad(CAST(i AS VARCHAR), 8, '0') AS task_id FROM n, range(0, n.n) t(i)),
r AS (SELECT sample, task_id, {_listed(generators.ROTATION_SHAPES)}[{_drawn("task_id", "shape", 0, 3)} + 1] AS shape, {_drawn("task_id", "x", 150, 362)} AS x, {_drawn("task_id", "y", 150, 362)} AS y, {_drawn("task_id", "angle", 30, 330)} AS angle,
  CASE WHEN {_drawn("task_id", "direction", 0, 1)} = 0 THEN 'clockwise' ELSE 'counterclockwise' END AS direction, {_drawn("task_id", "initial", 0, 359)} AS initial,
  {_drawn("task_id", "colour0", 50, 200)} || ',' || {_drawn("task_id", "colour1", 50, 200)} || ',' || {_drawn("task_id", "colour2", 50, 200)} AS colour FROM ids)
SELECT sample, task_id, shape, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(angle AS INT) AS angle, direction, CAST(initial AS INT) AS initial, colour FROM r
QUALIFY row_number() OVER (PARTITION BY shape, direction, round_even(angle / 5.0, 0), round_even(initial / 5.0, 0), round_even(x / 5.0, 0), round_even(y / 5.0, 0) ORDER BY sample) = 1""",
)
def rotation_parameters(spark, sf_dir):
    return generators.rotation_parameters(spark, T.table(spark, sf_dir, "documents").count()).withColumn("colour", joined("colour"))


@query(
    "puzzle_parameters",
    f"""WITH {SAMPLES_ASKED}, ids AS (SELECT i AS sample, 'puzzle_' || lpad(CAST(i AS VARCHAR), 8, '0') AS task_id FROM n, range(0, n.n) t(i)),
cells AS (SELECT *, {_drawn("task_id", "difficulty", 1, 4)} AS turned, row_number() OVER (PARTITION BY sample ORDER BY md5('0:' || task_id || ':cell' || c), c) AS place, 1 + ('0x' || substring(md5('0:' || task_id || ':angle' || c), 1, 8))::BIGINT % 359 AS angle FROM ids, (VALUES (0), (1), (2), (3)) v(c))
SELECT sample, task_id, CAST(turned AS INT) AS turned, string_agg(CASE WHEN place <= turned THEN angle ELSE 0 END, ',' ORDER BY c) AS angles FROM cells GROUP BY sample, task_id, turned""",
)
def puzzle_parameters(spark, sf_dir):
    return generators.puzzle_parameters(spark, T.table(spark, sf_dir, "documents").count()).withColumn("angles", joined("angles"))


@query(
    "analogy_parameters",
    f"""WITH {SAMPLES_ASKED}, d AS (SELECT id, {_drawn("id", "shape_1", 0, 19)} AS s1, {_drawn("id", "shape_2", 0, 18)} AS s2, {_drawn("id", "colour_1", 0, 399)} AS c1, {_drawn("id", "colour_2", 0, 398)} AS c2, {_drawn("id", "move_1", 0, 10)} AS m1, {_drawn("id", "move_2", 0, 9)} AS m2 FROM n, range(0, 2 * n.n + 64) t(id)),
r AS (SELECT id, s1, (s1 + 1 + s2) % 20 AS s2, c1, (c1 + 1 + c2) % 400 AS c2, m1, (m1 + 1 + m2) % 11 AS m2 FROM d),
f AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY s1, s2, c1, c2, m1, m2 ORDER BY id) = 1))
SELECT place, {_listed(generators.ANALOGY_SHAPES)}[s1 + 1] AS shape, {_listed(generators.ANALOGY_SHAPES)}[s2 + 1] AS second_shape, CAST(c1 AS INT) AS colour_from, CAST(c2 AS INT) AS colour_to, {_listed(generators.MOVES)}[m1 + 1] AS move_from, {_listed(generators.MOVES)}[m2 + 1] AS move_to, {_listed(generators.MOVES.values())}[m2 + 1] AS move_pixels FROM f, n WHERE place < n.n""",
)
def analogy_parameters(spark, sf_dir):
    return generators.analogy_parameters(spark, T.table(spark, sf_dir, "documents").count())


@query("complete_metadata", "SELECT p_partkey, p_partkey % 7 NOT IN (1, 2, 3, 4, 5) AS complete FROM part")
def complete_metadata(spark, sf_dir):
    i = F.col("p_partkey") % 7
    parameters = F.when(i == 1, F.lit("[1, 2]")).otherwise(F.lit('{"size": 3}'))
    seed = F.when(i == 2, F.lit("")).otherwise(F.lit('"seed": 5, '))
    commit = F.when(i == 3, F.lit("{}")).otherwise(F.lit('{"commit": "abc"}'))
    stamp = F.when(i == 4, F.lit("")).otherwise(F.lit('"timestamp": "2024-01-01", '))
    hashed = F.when(i == 5, F.lit("short")).otherwise(F.lit("0123456789abcdef"))
    record = P.text('{"task_id": "t', F.col("p_partkey"), '", "generator": "g", ', stamp, '"parameters": ', parameters, ', "param_hash": "', hashed, '", "generation": {', seed, '"git": ', commit, "}}")
    return T.table(spark, sf_dir, "part").select("p_partkey", generators.complete_metadata(record).alias("complete"))


@query("placement_layouts")
def placement_layouts(spark, sf_dir):
    return generators.placement_layouts(spark, T.table(spark, sf_dir, "documents").count())


@query("coin_balance", "SELECT count(*) FILTER (WHERE substring(md5('5:' || doc_id || ':x'), 1, 1) < '8') AS heads, count(*) AS n FROM documents")
def coin_balance(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").agg(F.count_if(coin(5, "doc_id", "x")).alias("heads"), F.count("*").alias("n"))


@query("drawn_order", "SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id || ':shuffle'), doc_id) - 1 AS place FROM documents")
def drawn_order(spark, sf_dir):
    return windows.ordinal(T.table(spark, sf_dir, "documents").select("doc_id", draw(0, "doc_id", "shuffle").alias("h")), "h", "doc_id", name="place").drop("h")


# -- recipes --------------------------------------------------------------------------


def _samples(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    frame = lambda k: P.text("w/", F.col("doc_id"), f"/{k}.png")
    task = F.array(F.lit("maze"), F.lit("stable_sort"), F.lit("grid_shift"))[(F.col("doc_id") % 3).cast("int")]
    parameters = P.text('{"grid_size": ', F.col("doc_id") % 9, ', "direction": "left", "steps": 3, "color": [255, 160, 0]}')
    return docs.select(F.col("doc_id").alias("window_id"), task.alias("task_name"), F.lit("Spatiality").alias("category"), F.array(*[frame(k) for k in range(4)]).alias("frames"), parameters.alias("raw_parameters"))


SAMPLES = """samples AS (SELECT doc_id AS window_id, ['maze', 'stable_sort', 'grid_shift'][doc_id % 3 + 1] AS task_name, 'w/' || doc_id || '/' AS stem FROM documents)"""


@query(
    "synthetic_rows",
    f"""WITH {SAMPLES}, r AS (SELECT *, substring(md5('0:' || window_id || ':direction'), 1, 1) < '8' AS back, row_number() OVER (PARTITION BY task_name ORDER BY window_id) - 1 AS n FROM samples)
SELECT 'syn_' || task_name || '_' || lpad(CAST(n AS VARCHAR), 5, '0') AS id, CASE WHEN back THEN 'backward' ELSE 'forward' END AS direction, CASE WHEN back THEN stem || '0.png' ELSE stem || '3.png' END AS target_image, CASE WHEN back THEN stem || '1.png' ELSE stem || '2.png' END AS cond_image, '<img>' AS answer,
CASE task_name WHEN 'maze' THEN 'This is a top-down ' || (window_id % 9) || '×' || (window_id % 9) || ' grid-maze video' WHEN 'stable_sort' THEN 'This is a top-down sorting video' ELSE 'This is a top-down grid video' END AS opening FROM r""",
)
def synthetic_rows(spark, sf_dir):
    found = _turns(recipes.synthetic_rows(_samples(spark, sf_dir), choice="mixed", bare=True))
    return found.select("id", "direction", "target_image", "cond_image", "answer", F.regexp_extract("human", "This is a top-down [^:]*video", 0).alias("opening"))


@query(
    "synthetic_dual_rows",
    f"""WITH {SAMPLES}, h AS (SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY md5('0:' || window_id || ':holdout'), window_id) <= 20 AS held FROM samples),
r AS (SELECT *, row_number() OVER (PARTITION BY task_name, held ORDER BY window_id) - 1 AS n, count(*) OVER (PARTITION BY task_name, held) AS size FROM h)
SELECT 'syn_' || task_name || '_dual_' || CASE WHEN held THEN 'eval' ELSE 'train' END || '_' || lpad(CAST(n AS VARCHAR), 5, '0') AS id, held AS eval_holdout, stem || '3.png' AS target_image, stem || '2.png' AS cond_image, 7 AS n_images FROM r WHERE size > 3""",
)
def synthetic_dual_rows(spark, sf_dir):
    found = recipes.synthetic_dual_rows(_samples(spark, sf_dir), held_out=20)
    return found.select("id", "eval_holdout", "target_image", "cond_image", F.size("image").alias("n_images"))


@query(
    "merged_setting",
    """WITH top AS (SELECT max(doc_id) + 1 AS n FROM documents), e AS (SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 5 <> 0),
k AS (SELECT source, doc_id FROM documents, top WHERE CAST(doc_id AS VARCHAR) IN (SELECT path FROM e) AND CAST(doc_id * 3 % n AS VARCHAR) IN (SELECT path FROM e))
SELECT 'S0_' || lpad(CAST(row_number() OVER (ORDER BY source NULLS LAST, doc_id) - 1 AS VARCHAR), 6, '0') AS id, CAST(doc_id AS VARCHAR) AS orig_id, source FROM k""",
)
def merged_setting(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    number = lambda c: c.cast("string")
    n = _id_range(spark, sf_dir)
    rows_ = docs.select("source", F.col("doc_id").alias("id"), F.col("doc_id").alias("_row"), F.array(number(F.col("doc_id"))).alias("image"), number(F.col("doc_id") * 3 % n).alias("target_image"))
    existing = docs.filter("doc_id % 5 <> 0").select(number(F.col("doc_id")).alias("path"))
    return recipes.existing_only(sets.merge_tagged(rows_, F.col("source").asc_nulls_last(), "_row", "S0"), existing, "S0").select("id", "orig_id", "source")


def _progressions(spark, sf_dir):
    found = _captioned(spark, sf_dir).withColumn("conversations", rows.conversation(F.lit(""), F.lit("")))
    prefixes = found.select(F.col("image").alias("context_paths"), "caption_prefix", F.lit(0).alias("place")).distinct()
    skeleton, manifest = recipes.progression_inputs(found.drop("caption_prefix"), prefixes, "place")
    odd = F.substring(F.md5("id"), 1, 1) < "2"
    labels = manifest.select("id", F.when(odd, "unreadable").otherwise(P.text("Progression: moves\nNext frame: stops at ", F.col("target_image"))).alias("raw"), F.lit(0).alias("place"))
    return recipes.filled_progressions(skeleton, labels, "S4", "id", "place")


@query(
    "filled_progressions",
    f"""WITH {ANCHORS}, k AS (SELECT example_id, cands[answer_index + 1] AS t FROM anchors WHERE NOT substring(md5(example_id), 1, 1) < '2')
SELECT 'S4_' || lpad(CAST(row_number() OVER (ORDER BY example_id) - 1 AS VARCHAR), 6, '0') AS id, example_id AS orig_id, 'moves. Next frame prediction: stops at ' || t || '. The next frame should look like this: <img>' AS answer FROM k""",
)
def filled_progressions(spark, sf_dir):
    return _turns(_progressions(spark, sf_dir)[0]).select("id", "orig_id", "answer")


@query("progressions_dropped", f"WITH {ANCHORS} SELECT example_id AS id FROM anchors WHERE substring(md5(example_id), 1, 1) < '2'")
def progressions_dropped(spark, sf_dir):
    return _progressions(spark, sf_dir)[1]


@query("usable_pool", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 2 = 0 AND source <> 'src3'")
def usable_pool(spark, sf_dir):
    pool = T.table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "en").alias("kitchen"), (F.col("doc_id") % 2 == 0).alias("manipulation"), F.when(F.col("source") == "src3", "undesirable").otherwise("desirable").alias("desirable_filtering"))
    return recipes.usable_pool(pool).select("doc_id")


@query("split_scan", f"WITH {SCORES} SELECT s.id, v.run, CASE WHEN s.run = v.run THEN rule_score END AS score FROM scores s, (VALUES ('s0'), ('s1'), ('s2')) v(run)")
def split_scan(spark, sf_dir):
    found = T.scores(spark, sf_dir)
    return recipes.split_scan(found.select("id", "task_name"), ["s0", "s1", "s2"], found.select("id", "run", F.col("rule_score").alias("score"))).select("id", "run", "score")


@query("anchors_with_texts")
def anchors_with_texts(spark, sf_dir):
    config = recipes.SourceConfig("clips", cross_clip=True, target=150, cap=5)
    found = recipes.anchors(T.clips(spark, sf_dir), config, T.segments(spark, sf_dir))
    return found.select("example_id", "action_text", joined("candidate_paths").alias("candidate_paths"), "answer_index", "negative_kind")
