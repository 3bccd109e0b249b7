"""Registered queries of the small column and filter operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import scenes
from ..functions import scores as S
from ..operators import generators, joins, objects, reports, rows, sets, windows
from . import recipes
from . import tables as T
from .queries import ANCHORS, CLIPS, OBJECTS, SCORES, TRANSITIONS, joined, query


def _setting(spark, sf_dir):
    """Anchors as rows of three sources, and the manifest of their paths."""
    found = T.anchors(spark, sf_dir)
    source = F.array(F.lit("kitchen"), F.lit("robot"), F.lit("video"))[F.col("clip_id").cast("int") % 3]
    setting = found.select(F.col("example_id").alias("id"), source.alias("source"), F.col("context_paths").alias("image"))
    return setting, found.select("context_paths", "action_text")


PREFIXES = {
    "kitchen": lambda manifest: P.kitchen_prefix(F.size("context_paths"), manifest["action_text"]),
    "robot": lambda manifest: P.navigation_action_prefix(F.size("context_paths"), manifest["action_text"]),
    "video": lambda manifest: P.video_prefix(P.text("  ", manifest["action_text"], "\n")),
}


@query(
    "caption_prefixes",
    f"""WITH {ANCHORS} SELECT example_id AS id, array_to_string(ctx, ',') AS context_paths,
CASE clip_id % 3 WHEN 0 THEN 'These are 3 consecutive first-person camera frames from an egocentric kitchen video. Action being performed after the last frame: ' || action_text
 WHEN 1 THEN 'These are three consecutive first-person camera frames from an egocentric navigation video sequence. Action to execute from the last frame: ' || action_text
 ELSE 'Video description: ' || action_text END AS caption_prefix FROM anchors""",
)
def caption_prefixes(spark, sf_dir):
    setting, manifest = _setting(spark, sf_dir)
    found = [recipes.caption_prefixes(setting, source, manifest, extract) for source, extract in PREFIXES.items()]
    return found[0].union(found[1]).union(found[2]).withColumn("context_paths", joined("context_paths"))


@query("percent_scores", "SELECT doc_id, greatest(0.0, least(1.0, (doc_id % 140 - 20) / 100.0::DOUBLE)) AS score FROM documents")
def percent_scores(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", S.percent_score(F.col("doc_id") % 140 - 20).alias("score"))


@query("plain_prompts", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'See <image>' || chr(10) || text ELSE text END AS prompt FROM documents")
def plain_prompts(spark, sf_dir):
    even = F.when(F.col("doc_id") % 2 == 0, P.text("<image>\n", F.col("text"))).when(F.col("doc_id") % 4 == 1, P.text("See <image>\n", F.col("text"))).otherwise(F.col("text"))
    return T.table(spark, sf_dir, "documents").select("doc_id", rows.without_image_block(even).alias("prompt"))


@query("short_tasks", "SELECT doc_id, source || '_' || lang AS task FROM documents")
def short_tasks(spark, sf_dir):
    generator = P.text("G-", F.col("doc_id"), "_", F.col("source"), "_", F.col("lang"), "_data-generator")
    return T.table(spark, sf_dir, "documents").select("doc_id", P.short_task(generator).alias("task"))


@query("public_addresses", "SELECT doc_id, 'https://host.example/' || source || '/' || doc_id AS address FROM documents")
def public_addresses(spark, sf_dir):
    user = F.when(F.col("doc_id") % 2 == 0, "someone:t0ken@").otherwise("")
    remote = P.text("https://", user, "host.example/", F.col("source"), "/", F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, ".git").otherwise(""))
    return T.table(spark, sf_dir, "documents").select("doc_id", generators.without_credentials(remote).alias("address"))


@query("long_clips", f"WITH {CLIPS} SELECT clip_id, num_frames FROM clips WHERE num_frames >= 20 + 3")
def long_clips(spark, sf_dir):
    return windows.long_enough(T.clips(spark, sf_dir), 3, 21).select("clip_id", "num_frames")


@query("eligible_clips", f"WITH {TRANSITIONS} SELECT clip_id, num_frames FROM clips WHERE clip_id IN (SELECT clip_id FROM transitions)")
def eligible_clips(spark, sf_dir):
    return windows.eligible(T.clips(spark, sf_dir), T.transitions(spark, sf_dir)).select("clip_id", "num_frames")


@query("objects_by_area", f"WITH {OBJECTS} SELECT image_id, role, idx, CASE WHEN area >= 600 THEN 'shape' ELSE 'marker' END AS kind FROM (SELECT * REPLACE (area - 300 AS area) FROM objects) WHERE area >= 30")
def objects_by_area(spark, sf_dir):
    shifted = T.objects(spark, sf_dir).withColumn("area", F.col("area") - 300)
    return objects.by_area(shifted).select("image_id", "role", "idx", "kind")


@query("downloaded_documents", "SELECT doc_id FROM documents WHERE doc_id % 5 > 1 AND source IS NOT NULL AND lang = 'en'")
def downloaded_documents(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    path = P.text(F.col("source"), "/", F.col("doc_id"))
    status = F.when(F.col("doc_id") % 5 > 1, "success").when(F.col("doc_id") % 5 == 1, "failed")
    listing = docs.filter("lang = 'en'").select(path.alias("path"))
    return joins.downloaded(docs.select("doc_id", status.alias("status"), path.alias("file")), path="file", existing=listing).select("doc_id")


@query("distinct_sources", "SELECT lang, count(DISTINCT source) AS n_groups FROM documents GROUP BY lang")
def distinct_sources(spark, sf_dir):
    return reports.distinct_groups(T.table(spark, sf_dir, "documents"), ["lang"], "source")


@query("first_records", f"WITH {SCORES} SELECT task_name, arg_min(run, id) AS run, arg_min(domain, id) AS domain FROM scores GROUP BY task_name")
def first_records(spark, sf_dir):
    return reports.with_first(T.scores(spark, sf_dir), "task_name", "id", "run", "domain")


@query(
    "ranked_tasks",
    f"""WITH {SCORES}, means AS (SELECT domain, task_name, round(avg(rule_score), 9) AS mean FROM scores GROUP BY domain, task_name)
SELECT *, CAST(row_number() OVER (PARTITION BY domain ORDER BY coalesce(mean, 0) DESC, task_name NULLS FIRST) AS INT) AS place FROM means""",
)
def ranked_tasks(spark, sf_dir):
    means = T.scores(spark, sf_dir).groupBy("domain", "task_name").agg(F.round(F.avg("rule_score"), 9).alias("mean"))
    return reports.ranked_tasks(means, "domain", "task_name", "mean")


@query("names_only_in", "SELECT source FROM documents WHERE lang = 'en' EXCEPT SELECT source FROM documents WHERE lang <> 'en' AND doc_id % 40 = 0")
def names_only_in(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    return sets.names_only_in(docs.filter("lang = 'en'"), docs.filter("lang <> 'en' and doc_id % 40 = 0"), "source")


@query("questions", "SELECT 'rotation_puzzle' AS task_name, unnest(['board_intact', 'cells_correct', 'joins_closed', 'no_extra_marks']) AS question")
def questions(spark, sf_dir):
    return scenes.questions_table(spark).select("task_name", "question")
