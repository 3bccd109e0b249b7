import numpy as np

from reelforge.llm import quality

SCHEMA = "doc_id long, text string, selected int"


def rows():
    rng = np.random.default_rng(1)
    good, bad = [f"w{i}" for i in range(50)], [f"w{i}" for i in range(30)] + ["%%%", "|", "!!"]
    out = [(1, None, 0), (2, "", 0), (3, " \n", 0), (None, "w1 w2", 0)]
    for i in range(200):
        out.append((10 + i, " ".join(rng.choice(bad if i % 4 == 0 else good, size=rng.integers(3, 80))), 0))
    return [*out, out[30], (9000, " ".join(good * 400), 0)]


def test_matches_brute_force(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    target = [10 + i for i in range(200) if i % 4 and i < 100]
    got = [tuple(r) for r in quality.select(frame, spark.createDataFrame([(t,) for t in target] + [(None,), (target[0],)], "doc_id long"), 0.5, buckets=500).collect()]
    feats = [quality.features(t, 500) for _, t, _ in rows()]
    raw, own = np.zeros(500), np.zeros(500)
    for (i, *_), f in zip(rows(), feats, strict=True):
        np.add.at(raw, f, 1)
        if i in target:
            np.add.at(own, f, 1)
    ratio = np.log((own + 1) / (own.sum() + 500)) - np.log((raw + 1) / (raw.sum() + 500))
    want = []
    for (i, *_), f in zip(rows(), feats, strict=True):
        weight = ratio[f].sum()
        want.append((i, weight, weight + quality.gumbel(np.array([-1 if i is None else i]), 42)[0]) if len(f) else (i, None, None))
    k = round(0.5 * len(rows()))
    cut = sorted((w[2] for w in want if w[2] is not None), reverse=True)[k - 1]
    assert sum(r[3] for r in got) == k
    place = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(got, key=place), sorted(want, key=place), strict=True):
        assert g[0] == w[0] and (g[1] is None) == (w[1] is None)
        if w[1] is None:
            assert not g[3]
        else:
            assert abs(g[1] - w[1]) < 1e-6 and (g[3] == (w[2] >= cut) or abs(w[2] - cut) < 1e-6)


def test_prefers_the_target(spark):
    frame = spark.createDataFrame(rows()[:-1], SCHEMA)
    target = spark.createDataFrame([(10 + i,) for i in range(200) if i % 4 and i < 100], "doc_id long")
    by = {r.doc_id: r.selected for r in quality.select(frame, target, 0.5, buckets=500).collect()}
    assert np.mean([by[10 + i] for i in range(0, 200, 4)]) < np.mean([by[10 + i] for i in range(200) if i % 4]) - 0.3


def test_order_of_keys():
    keys = np.array([-np.inf, -5.5, -1.0, -1e-300, 0.0, 1e-300, 2.0, 1e10])
    assert (np.diff(quality.ordered(keys)) > 0).all()


def test_empty_and_no_targets(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.select(spark.createDataFrame([], SCHEMA), none, 0.5).collect() == []
    got = quality.select(spark.createDataFrame([(1, "a b", 0), (2, "c", 0), (3, None, 0)], SCHEMA), none, 0.9).collect()
    assert sorted((r.doc_id, r.log_weight, r.selected) for r in got if r.doc_id < 3) == [(1, 0.0, True), (2, 0.0, True)]
