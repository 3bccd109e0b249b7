import random
import re
from collections import Counter

from reelforge.llm import substring_dedup

SCHEMA = "doc_id long, text string, place int"
W = substring_dedup.WINDOW


def brute(rows, only=None):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    seen = Counter(tuple(w[s : s + W]) for w in words for s in range(len(w) - W + 1))
    out = []
    for i, ((doc, _, _), w) in enumerate(zip(rows, words, strict=True)):
        if only is not None and i not in only:
            continue
        gone = set()
        for s in range(len(w) - W + 1):
            if seen[tuple(w[s : s + W])] > 1:
                gone |= set(range(s, s + W))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def got(spark, rows, **kwargs):
    return sorted(map(tuple, substring_dedup.remove_repeated(spark.createDataFrame(rows, SCHEMA), **kwargs).collect()), key=str)


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Ünï", "x.", "中"]
    passages = [rng.choices(vocabulary, k=rng.choice([34, 35, 36, 50, 90, 200])) for _ in range(12)]
    rows = [(1, None, 0), (2, "", 0), (3, "a " * 34, 0), (4, "a " * 36, 0), (5, "b " * 300 + "c", 0), (6, "x\x0by z   q", 0), (None, " ".join(passages[3]) + " tail", 0), (7, "a b " * 60, 0)]
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choices(vocabulary, k=rng.randint(0, 60))
            if rng.random() < 0.6:
                p = list(rng.choice(passages))
                if rng.random() < 0.4:
                    p[rng.randrange(len(p))] = "edit"
                a = rng.randrange(len(p))
                parts += p if rng.random() < 0.5 else p[a:]
        rows.append((10 + i, rng.choice([" ", "\n", "  \t"]).join(parts), 0))
    rows += [rows[20], (20, "same id and another text " + " ".join(passages[2]), 0)]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert sum(r[2] for r in want) > 3000 and any(0 < r[2] < r[1] for r in want)
    assert got(spark, rows) == want


def test_batches_do_not_matter(spark):
    rows = corpus()[:50]
    want = brute(rows)
    assert got(spark, rows, batches=1) == want
    assert got(spark, rows, batches=5) == want


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, "one two", 3)]) == [(1, 2, 0, "one two")]


def test_an_index_is_opened_again_and_asked_with_the_next_batch(spark, tmp_path):
    rows, where = corpus(), str(tmp_path / "index's")
    days = [rows[0::3], rows[1::3], rows[2::3]]
    frames = [spark.createDataFrame(day, SCHEMA) for day in days]
    history = None
    for day, frame in enumerate(frames):
        index = substring_dedup.FingerprintIndex(spark, where)
        assert (index.version, len(index.batches)) == (day, day)
        got = sorted(map(tuple, substring_dedup.remove_in_batch(index, frame, history).collect()), key=str)
        so_far = [row for past in days[: day + 1] for row in past]
        want = brute(so_far, only=range(len(so_far) - len(days[day]), len(so_far)))
        assert got == want
        history = frame if history is None else history.union(frame)
    assert [len(level) for level in index.levels] == [1, 1]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("reelforge")]


def test_runs_are_merged_without_shuffle_or_sort(spark, tmp_path):
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path / "index"))
    a, b = (index._run(index._batch(spark.createDataFrame(corpus()[k::2], SCHEMA))[1]) for k in range(2))
    with substring_dedup._bucketed_joins(spark):
        joined = a.join(b.hint("merge"), ["g", "span"], "full")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_a_row_repeated_very_often(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 0)] * 3000 + [(2, text + " tail", 0), (3, "other " * 20 + text[: text.index("w50")], 0)]
    assert got(spark, rows) == brute(rows)
