"""Registered queries of readers and writers: each writes its table to the shared
folder and reads it back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..sources import readers, sinks
from ..sources.shared import shared_folder
from . import tables as T
from .queries import query

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def _documents(spark, sf_dir) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


@query("json_lines_round_trip", "SELECT doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def json_lines_round_trip(spark, sf_dir):
    where = shared_folder(spark, "json-lines")
    sinks.json_lines(_documents(spark, sf_dir), where)
    return readers.json_lines(spark, where, DOCUMENT, strict=True)


@query("json_lines_counted", "SELECT count(*) AS written FROM documents")
def json_lines_counted(spark, sf_dir):
    n = sinks.json_lines(_documents(spark, sf_dir), shared_folder(spark, "json-lines-counted"))
    return spark.createDataFrame([(n,)], "written long")


@query(
    "malformed_lines",
    """SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS doc_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 7 = 0 THEN '{"doc_id": ' || doc_id || ', broken' END AS malformed FROM documents""",
)
def malformed_lines(spark, sf_dir):
    where = shared_folder(spark, "malformed")
    good = F.to_json(F.struct("doc_id", "lang"))
    line = F.when(F.col("doc_id") % 7 == 0, P.text('{"doc_id": ', F.col("doc_id"), ", broken")).otherwise(F.when(F.col("doc_id") % 5 == 0, F.concat(good, F.lit("\n   "))).otherwise(good))
    _documents(spark, sf_dir).select(line.alias("value")).write.text(where)
    return readers.json_lines_with_place(spark, where, "doc_id long, lang string").select("doc_id", "lang", "malformed")


@query("tagged_rows", "SELECT doc_id, 'web' AS source FROM documents")
def tagged_rows(spark, sf_dir):
    return readers.tagged(T.table(spark, sf_dir, "documents").select("doc_id"), "web")


@query("json_map", "SELECT CAST(n_nationkey AS VARCHAR) AS nation, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def json_map(spark, sf_dir):
    where = shared_folder(spark, "json-map")
    nations = T.table(spark, sf_dir, "nation").collect()  # a file with one object holds a small table
    sinks.write_text(spark, f"{where}/nations.json", json.dumps({str(r["n_nationkey"]): {"name": r["n_name"], "region": r["n_regionkey"]} for r in nations}))
    return readers.json_map(spark, f"{where}/nations.json", "name string, region long", "nation")


@query("csv_table", "SELECT CAST(p_partkey AS BIGINT) AS part, trim(p_brand) AS brand, CAST(p_size AS BIGINT) AS size FROM part")
def csv_table(spark, sf_dir):
    where = shared_folder(spark, "csv")
    padded = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("brand"), F.col("p_size").alias("size"))
    padded.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(where, header=True)
    return readers.csv_table(spark, where, "part long, brand string, size long")


@query("id_list", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents")
def id_list(spark, sf_dir):
    where = shared_folder(spark, "id-list")
    sinks.id_list(T.table(spark, sf_dir, "documents"), "doc_id", where)
    return readers.id_list(spark, where)


def _region_files(spark, sf_dir) -> str:
    where = shared_folder(spark, "sidecars")
    for r in T.table(spark, sf_dir, "region").collect():  # a file for each of a handful of rows
        sinks.write_text(spark, f"{where}/r{r['r_regionkey']}/{r['r_name'].replace(' ', '_')}.json", json.dumps({"key": r["r_regionkey"]}, indent=1))
        if r["r_regionkey"] % 2:
            sinks.write_text(spark, f"{where}/r{r['r_regionkey']}/frame.png", "x")
    return where


@query("sidecars", "SELECT replace(r_name, ' ', '_') AS id, CAST(r_regionkey AS BIGINT) AS key FROM region")
def sidecars(spark, sf_dir):
    return readers.sidecars(spark, f"{_region_files(spark, sf_dir)}/*/*.json", "key long")


@query("listing", "SELECT 'r' || r_regionkey || '/' || replace(r_name, ' ', '_') || '.json' AS path FROM region UNION ALL SELECT 'r' || r_regionkey || '/frame.png' FROM region WHERE r_regionkey % 2 = 1")
def listing(spark, sf_dir):
    found = readers.listing(spark, _region_files(spark, sf_dir))
    return found.select(F.regexp_extract("path", r"([^/]+/[^/]+)\z", 1).alias("path"))


@query("complete_folders", "SELECT 'f' || (doc_id // 4) AS folder FROM documents WHERE doc_id % 4 < 3 GROUP BY 1 HAVING count(DISTINCT doc_id % 4) = 3")
def complete_folders(spark, sf_dir):
    i = F.col("doc_id")
    name = F.array(*[F.lit(x) for x in ("first.png", "last.png", "prompt.txt", "extra.json")])[(i % 4).cast("int")]
    paths = T.table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.floor(i / 4).cast("string"), F.lit("/"), name).alias("path"))
    return readers.complete_folders(paths, ["first.png", "last.png", "prompt.txt"])


@query("video_ids", "SELECT DISTINCT 'P' || (doc_id % 90) AS video_id FROM documents WHERE doc_id % 3 <> 0")
def video_ids(spark, sf_dir):
    i = F.col("doc_id")
    ending = F.when(i % 3 == 0, ".txt").otherwise(".MP4")
    return readers.video_ids(T.table(spark, sf_dir, "documents").select(F.concat(F.lit("/v/"), (i % 7).cast("string"), F.lit("/P"), (i % 90).cast("string"), ending).alias("path")))


@query("join_systems", "SELECT 'base' AS run, doc_id AS id, quality AS score FROM labels UNION ALL SELECT 'tuned', doc_id, toxic FROM labels")
def join_systems(spark, sf_dir):
    labels = T.table(spark, sf_dir, "labels")
    records = lambda score: labels.groupBy((F.col("doc_id") % 64).alias("_file")).agg(F.collect_list(F.struct(F.col("doc_id").alias("id"), F.col(score).alias("score"))).alias("records"))
    return readers.join_systems({"base": records("quality"), "tuned": records("toxic")})


def _answer(prompt: str, images: list[str]) -> str | None:
    """A stand-in for a labelling service."""
    if prompt.endswith("3"):
        raise RuntimeError("refused")
    return None if prompt.endswith("7") else f"{prompt}: {len(images)}"


@query(
    "labelled_rows",
    "SELECT doc_id, CASE WHEN doc_id % 10 NOT IN (3, 7) THEN doc_id || ': 2' END AS response, CASE WHEN doc_id % 10 = 3 THEN 'refused' WHEN doc_id % 10 = 7 THEN 'no answer' END AS error FROM documents",
)
def labelled_rows(spark, sf_dir):
    asked = T.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("prompt"), F.array(F.lit("a.png"), F.lit("b.png")).alias("images"))
    return readers.label(asked, lambda: _answer, "prompt", "images").select("doc_id", "response", "error")


@query("sorted_keys", """SELECT doc_id, '{"a":{"b":' || (doc_id % 3) || ',"c":' || doc_id || '},"doc_id":' || doc_id || ',"z":[{"x":1,"y":2}]}' AS line FROM documents""")
def sorted_keys(spark, sf_dir):
    i = F.col("doc_id")
    mixed = T.table(spark, sf_dir, "documents").select(F.array(F.struct(F.lit(2).alias("y"), F.lit(1).alias("x"))).alias("z"), "doc_id", F.struct(i.alias("c"), (i % 3).alias("b")).alias("a"))
    ordered = sinks.sorted_keys(mixed)
    return ordered.select("doc_id", F.to_json(F.struct(*ordered.columns)).alias("line"))


@query("dataset_description", "SELECT 'docs' AS name, count(*) AS length, 'imgen' AS task_type FROM documents")
def dataset_description(spark, sf_dir):
    where = shared_folder(spark, "dataset")
    sinks.dataset(T.table(spark, sf_dir, "documents").select("doc_id", "source"), where, "docs")
    text = spark.read.text(f"{where}/meta.json", wholetext=True)
    meta = F.from_json("value", "map<string, struct<length: long, task_type: string>>")
    return text.select(F.explode(meta).alias("name", "m")).select("name", "m.length", "m.task_type")


@query("safe_rewrite", "SELECT doc_id, lang, doc_id % 2 = 0 AS kept FROM documents")
def safe_rewrite(spark, sf_dir):
    where = f"{shared_folder(spark, 'rewrite')}/rows"
    sinks.json_lines(T.table(spark, sf_dir, "documents").select("doc_id", "lang"), where)
    before = readers.json_lines(spark, where, "doc_id long, lang string")
    backup = sinks.rewrite(before.filter("doc_id % 2 = 0"), where)
    now, old = (readers.json_lines(spark, x, "doc_id long, lang string") for x in (where, backup))
    return now.withColumn("kept", F.lit(True)).union(old.filter("doc_id % 2 <> 0").withColumn("kept", F.lit(False)))


@query("summary_file", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def summary_file(spark, sf_dir):
    where = f"{shared_folder(spark, 'summary')}/summary.json"
    sinks.summary(spark, T.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")), where)
    return spark.read.schema("lang string, n long").option("multiLine", True).json(where)


@query("output_names", "SELECT r_regionkey, 'S4' || CASE WHEN r_regionkey % 2 = 1 THEN '_no_ce' ELSE '' END || CASE WHEN r_regionkey > 2 THEN '_backward' ELSE '' END || CASE WHEN r_regionkey < 2 THEN '_nocap' ELSE '' END AS name FROM region")
def output_names(spark, sf_dir):
    keys = [r["r_regionkey"] for r in T.table(spark, sf_dir, "region").collect()]  # names are made on the driver
    named = [(k, sinks.output_names("S4", bare=k % 2 == 1, direction="backward" if k > 2 else "forward", captions=k >= 2)) for k in keys]
    return spark.createDataFrame(named, "r_regionkey long, name string")
