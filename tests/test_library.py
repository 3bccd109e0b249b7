"""Sources, sinks, ledgers, generators and edge cases of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from reelforge.functions import prompts as P
from reelforge.functions import scores as S
from reelforge.operators import generators, joins, mining, objects, reports, rows, sets, splits, windows
from reelforge.sources import readers, sinks
from reelforge.streaming.ledger import resumable


def write(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    lines = write(tmp_path / "a.jsonl", '﻿{"id": 1, "x": "a"}\n\n{"id": 2}\n')
    assert [tuple(r) for r in readers.json_lines(spark, lines, "id long, x string").collect()] == [(1, "a"), (2, None)]
    bad = write(tmp_path / "b.jsonl", '{"id": 1}\nnonsense\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, bad, "id long", strict=True).collect()
    assert [r.malformed for r in readers.json_lines_with_place(spark, bad, "id long").collect()] == [None, "nonsense"]
    manifest = write(tmp_path / "m.json", json.dumps({"v1": {"fps": 5.0, "num_frames": 9}, "v2": {"fps": 2.5, "num_frames": 1}}))
    assert sorted(map(tuple, readers.json_map(spark, manifest, "fps double, num_frames int", "video_id").collect())) == [("v1", 5.0, 9), ("v2", 2.5, 1)]
    table = write(tmp_path / "t.csv", "video_id,start,text\n v1 ,3, pour water \n")
    assert [tuple(r) for r in readers.csv_table(spark, table, "video_id string, start int, text string").collect()] == [("v1", 3, "pour water")]
    assert [r.id for r in readers.id_list(spark, write(tmp_path / "ids.txt", "﻿ a \n\n b\n")).collect()] == ["a", "b"]
    for name in ("x", "y"):
        write(tmp_path / "side" / f"{name}.json", json.dumps({"caption": name * 2}))
    assert sorted(map(tuple, readers.sidecars(spark, str(tmp_path / "side" / "*.json"), "caption string").collect())) == [("xx", "x"), ("yy", "y")]


def test_listings(spark, tmp_path):
    for folder, names in {"00001": ["meta.json", "target.png"], "00002": ["meta.json"]}.items():
        for name in names:
            write(tmp_path / "tree" / folder / name, "x")
    write(tmp_path / "tree" / "P01.MP4", "x")
    paths = readers.listing(spark, str(tmp_path / "tree"))
    assert paths.count() == 4
    assert [r.folder[-5:] for r in readers.complete_folders(paths, ["meta.json", "target.png"]).collect()] == ["00001"]
    assert [r.video_id for r in readers.video_ids(paths).collect()] == ["P01"]


def test_labeller(spark):
    def connect():
        calls = {}

        def client(prompt, images):
            calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "never":
                raise TimeoutError("late")
            if prompt == "second" and calls[prompt] < 2:
                return None
            return f"{prompt}:{len(images)}"

        return client

    requests = spark.createDataFrame([(1, "now", ["a"]), (2, "second", []), (3, "never", ["a", "b"])], "id int, prompt string, images array<string>")
    got = {r.id: (r.response, r.error) for r in readers.label(requests, connect, "prompt", "images").collect()}
    assert got == {1: ("now:1", None), 2: ("second:0", None), 3: (None, "late")}


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "id int, z string, y string")
    meta = sinks.dataset(frame, str(tmp_path / "d"), "key")
    assert meta["key"]["length"] == 2 and json.loads((tmp_path / "d" / "meta.json").read_text()) == meta
    lines = [x for p in (tmp_path / "d" / "rows").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines) == ['{"id":1,"z":"a","y":"x"}', '{"id":2,"z":"b"}']
    nested = frame.select(F.struct("z", "id").alias("s"), F.array(F.struct("z", "id")).alias("l"), "id")
    assert sinks.sorted_keys(nested).select("l", "s").toJSON().first() == '{"l":[{"id":2,"z":"b"}],"s":{"id":2,"z":"b"}}'
    where = str(tmp_path / "d" / "rows")
    old = sinks.rewrite(spark.read.schema("id int, z string").json(where).filter("id = 1"), where)
    assert spark.read.json(where).count() == 1 and spark.read.json(old).count() == 2
    sinks.id_list(frame, "id", str(tmp_path / "ids"))
    assert [r.value for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["1", "2"]
    sinks.summary(spark, reports.count_by(frame, "z").orderBy("z"), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == [{"z": "a", "n": 1}, {"z": "b", "n": 1}]
    assert sinks.output_names("next", True, "mixed", False) == "next_no_ce_mixed_nocap"


def test_resumable_ledger(spark, tmp_path):
    source, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    for part in ([(1,), (2,), (2,)], [(2,), (3,)]):
        spark.createDataFrame(part, "id int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id int").parquet(source)
        run = resumable(stream, "id", lambda rows: rows.withColumn("done", F.lit(True)), ledger).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(ledger).collect()) == [1, 2, 3]


def test_strides_round_half_to_even(spark):
    clips = spark.createDataFrame([("a", 30, 5.0), ("b", 3, 30.0), ("c", 5, 2.0), ("d", 4, 2.0)], "clip_id string, num_frames int, fps double")
    assert {r.clip_id: (r.native_stride, r.n_grid) for r in windows.with_grid(clips, 2.0).collect()} == {"a": (2, 15), "b": (15, 1), "c": (1, 5), "d": (1, 4)}
    assert sorted(r.clip_id for r in windows.grid_windows(clips).select("clip_id").distinct().collect()) == ["a", "c"]
    assert [r.clip_id for r in windows.long_enough(clips.withColumn("duration_sec", F.col("num_frames") / F.col("fps")), 3, 2).filter("clip_id = 'b'").collect()] == []


def test_adaptive_tiers(spark):
    clips = spark.createDataFrame([(2.99, 299), (3.0, 300), (4.0, 400), (4.0, 4), (0.03, 3)], "d double, num_frames int").withColumn("fps", F.lit(100.0)).withColumn("clip_id", F.monotonically_increasing_id())
    got = [(r.num_frames, r.delta_s, r.delta_frames) for r in windows.adaptive_delta(clips).collect()]
    assert got == [(299, 0.5, 50), (300, 0.75, 75), (400, 1.0, 100), (4, None, None), (3, None, None)]
    assert max(r.ordinal for r in windows.adaptive_windows(clips.withColumn("num_frames", F.lit(5000)).limit(1)).collect()) == 6


def test_hard_negatives_follow_the_loop(spark):
    places = [0, 2, 4, 6, 8, 10, 12]
    data = [("v", c, c + 2, (c + 2) * 3) for c in places] + [("v", 13, 6, 18), ("w", 0, 2, 5), ("w", 2, 4, 9), ("w", 4, 6, 11)]
    frame = spark.createDataFrame(data, "clip_id string, current int, target_grid int, target_native int")
    want = {}
    for clip, c, grid, native in data:
        seen, pool = {native}, []
        for other in (r for r in data if r[0] == clip):
            if other[3] not in seen:
                seen.add(other[3])
                pool.append(other)
        if len(pool) >= 3:
            pool.sort(key=lambda r: abs(r[2] - grid))
            far = sorted(pool[2:], key=lambda r: -abs(r[2] - grid))[0]
            want[clip, c] = (pool[0][3], pool[1][3], far[3])
    got = {(r.clip_id, r.current): (r.near, r.mid, r.far) for r in mining.hard_negatives(frame).collect()}
    assert got == want


def test_lookup_policies(spark):
    left = spark.createDataFrame([(["a", "b"],), (["b", "a"],)], "k array<string>")
    table = spark.createDataFrame([(["a", "b"], "old", 1), (["a", "b"], "new", 2)], "k array<string>, v string, o int")
    with pytest.raises(joins.MissingKeys):
        joins.lookup(left, table, ["k"], "o")
    assert [r.v for r in joins.lookup(left, table, ["k"], "o", missing="skip").collect()] == ["new"]
    assert sorted(r.v for r in joins.lookup(left, table, ["k"], "o", missing="fallback", fallback={"v": F.lit("none")}).collect()) == ["new", "none"]


def test_statistics_without_variance(spark):
    frame = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, None), ("c", 1.0, 1.0), ("c", 2.0, 5.0), ("c", 2.0, 3.0)], "g string, x double, y double")
    got = {r.g: r.spearman for r in S.spearman(frame, ["g"], "x", "y").collect()}
    assert got["a"] is None and "b" not in got and abs(got["c"] - 0.8660254) < 1e-6
    assert reports.summary(frame.filter("g = 'b'"), "g", "y").filter("not is_total").first().mean_score is None


def test_no_correlation_with_a_constant_in_parts(spark):
    # merging the parts' moments leaves a variance of 3e-33: (1 / 103) * 103 is below 1
    x = (F.col("id") % 7).cast("double").alias("x")
    frame = spark.range(0, 206, 1, 2).select(F.lit("a").alias("g"), x, F.lit(1.0).alias("one"), (F.col("id") % 5).cast("double").alias("y"))
    got = frame.agg(S.pearson("x", "one").alias("right"), S.pearson("one", "x").alias("left"), S.pearson("x", "y").alias("both"), S.pearson("x", "x").alias("own")).first()
    assert got.right is None and got.left is None
    assert got.both is not None and abs(got.own - 1.0) < 1e-12
    assert S.spearman(frame, ["g"], "x", "one").first().spearman is None


def test_directions_and_prompts(spark):
    anchors = spark.createDataFrame([("e", ["0", "1", "2"], ["9", "3"], 1, " pour ")], "example_id string, context_paths array<string>, candidate_paths array<string>, answer_index int, caption string")
    back = rows.generation_rows(anchors, "backward", caption="caption", setting="S2").first()
    assert (back.image, back.target_image, back.cond_image, back.setting) == (["1", "2", "3"], "0", "1", "S2")
    assert back.conversations[0].value.startswith("<image>\n<image>\n<image>\nVideo description: pour\n\nThese are 3")
    none = rows.generation_rows(anchors.withColumn("caption", F.lit("")), "forward", caption="caption", flag=True).first()
    assert none.has_caption and "description" not in none.conversations[0].value
    with pytest.raises(ValueError):
        rows.direction("sideways", "example_id")
    with pytest.raises(Exception, match="condition frame"):
        rows.dual_rows(rows.selection_rows(anchors.withColumn("candidate_paths", F.array(F.lit("2"), F.lit("3"))))).collect()
    prompt = spark.range(1).select(P.choice_prompt(F.lit("A scene.")).alias("p"), P.navigation_prefix(F.lit(3), F.lit("go")).alias("n")).first()
    assert prompt.p.startswith("<image>\n<image>\n<image>\nA scene.\n\nYou are shown 3") and prompt.p.endswith("(A, B, C, or D).")
    assert prompt.n == "These are three consecutive first-person camera frames from an egocentric navigation video sequence. go"


def test_generators(spark):
    rotation = generators.rotation_parameters(spark, 300).collect()
    assert all(30 <= r.angle <= 330 and 0 <= r.initial < 360 and all(50 <= c <= 200 for c in r.colour) for r in rotation)
    assert len({(r["shape"], r.direction, r.angle, r.initial, r.x, r.y) for r in rotation}) == len(rotation)
    assert all(sum(a > 0 for a in r.angles) == r.turned for r in generators.puzzle_parameters(spark, 100).collect())
    combos = generators.analogy_parameters(spark, 200).collect()
    assert len({tuple(r)[1:] for r in combos}) == 200 and sorted(r.place for r in combos) == list(range(200))
    assert all(r.colour_from != r.colour_to and r.move_from != r.move_to and r["shape"] != r.second_shape for r in combos)
    assert all(generators.MOVES[r.move_to] == r.move_pixels for r in combos)
    with pytest.raises(ValueError):
        generators.analogy_parameters(spark, 111, shapes=("a", "b"), colours=2)
    layouts = generators.placement_layouts(spark, 40)
    assert objects.valid_layouts(layouts, 10.0).filter("not valid").count() == 0
    assert generators.canonical('{"b": 0.12345678, "a": {"image_path": 1, "c": [1.0000001]}, "my_seed": 3, "Video_Temp_Path": 1, "n": null, "é": true}') == '{"a": {"c": [1.0], "image_path": 1}, "b": 0.123457, "é": true}'
    url = spark.range(1).select(generators.without_credentials(F.lit("https://u:t@host/x/y.git")).alias("u")).first().u
    assert url == "https://host/x/y"


def test_greedy_matches_the_loop(spark):
    import random

    rng = random.Random(3)
    data = []
    for image in range(20):
        for role in ("gt", "cand"):
            for idx in range(rng.randint(1, 5)):
                data.append((str(image), role, idx, rng.uniform(0, 300), rng.uniform(0, 300), 100.0, (128.0, float(rng.choice([90, 100, 170])), 128.0), "square"))
    frame = spark.createDataFrame(data, "image_id string, role string, idx int, x double, y double, area double, lab struct<l:double,a:double,b:double>, shape string")
    want = {}
    for image in {d[0] for d in data}:
        pairs = sorted((abs(g[6][1] - c[6][1]) + ((g[3] - c[3]) ** 2 + (g[4] - c[4]) ** 2) ** 0.5, g[2], c[2]) for g in data for c in data if g[0] == c[0] == image and g[1] == "gt" and c[1] == "cand" and abs(g[6][1] - c[6][1]) <= 25)
        used = set()
        for _, g, c in pairs:
            if ("g", g) not in used and ("c", c) not in used:
                used |= {("g", g), ("c", c)}
                want[image, g] = c
    got = {(r.image_id, r.gt): r.cand for r in objects.greedy_match(frame).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want


def test_palette_and_renumbering(spark):
    labs = spark.createDataFrame([([(1.0, 0.0, 0.0), (2.0, 10.0, 0.0), (1.0, 90.0, 0.0)],)], "labs array<struct<l:double,a:double,b:double>>")
    assert labs.select(F.size(objects.palette(F.col("labs"))).alias("n")).first().n == 2
    frame = spark.range(95, -1, -1).withColumn("place", F.col("id") * 3)
    got = sets.renumber(frame, "place", key="k").orderBy("place").collect()
    assert [r.id for r in got] == [f"k_{i:06d}" for i in range(96)]


def test_disjointness_is_enforced(spark):
    with pytest.raises(Exception, match="overlap"):
        splits.require_disjoint(spark.range(5), spark.range(4, 6), "id").collect()


def test_presets_and_provenance():
    from reelforge.plans import recipes

    valid = ["maze", "rotation_puzzle"]
    assert recipes.resolve_tasks(None, "pilot5", valid, ["x"]) == ["rotation_puzzle"]
    assert recipes.resolve_tasks(["a"], None, valid, ["x"]) == ["a"] and recipes.resolve_tasks(None, None, valid, ["x"]) == ["x"]
    for bad in ((["a"], "pilot5", valid), (None, "other", valid), (None, "pilot5", ["maze"])):
        with pytest.raises(ValueError):
            recipes.resolve_tasks(*bad, [])
    assert "horizon: 2 grid-steps (1.00s)" in recipes.provenance(recipes.SourceConfig("clips"), 5, 2, "S0")
