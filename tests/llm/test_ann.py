import numpy as np
from pyspark.sql import functions as F

from reelforge.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank string"
ASKS = "vec_id % 20 = 0"


def brute(rows, k, length=16):
    sound = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v, _ in rows if i is not None and v is not None and len(v) == length and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return {q: sorted(((-float((sound[q] * v).sum()), i) for i, v in sound.items() if i != q))[:k] for q in sound if q % 20 == 0}


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(20, None, ""), (40, [0.0] * 16, ""), (60, [None] + [1.0] * 15, ""), (80, [float("nan")] * 16, ""), (100, [1.0] * 15, ""), (None, [1.0] * 16, ""), (120, [], "")]
    hot = rng.normal(size=16)
    for i in range(n):
        v = hot if rng.random() < 0.3 else rng.normal(size=16) * rng.choice([1, 1, 3])
        rows.append((200 + i, v.tolist(), ""))
    return rows


def search(spark, rows, k=20):
    got = {}
    for r in sorted(map(tuple, ann.search(spark.createDataFrame(rows, SCHEMA), F.expr(ASKS), k).collect())):
        got.setdefault(r[0], []).append(r[1:])
    return got


def test_recall_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 100)
    monkeypatch.setattr(ann, "SHARD", 300)
    monkeypatch.setattr(ann, "CHUNK", 40)
    rows = sample(2500)
    want, got = brute(rows, 20), search(spark, rows)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert [r[0] for r in found] == list(range(1, 21)) and len({r[1] for r in found}) == 20
        assert [(-r[2], r[1]) for r in found] == sorted((-r[2], r[1]) for r in found)
        true = dict((i, -s) for s, i in want[q])
        hits += sum(r[1] in true for r in found)
        assert all(abs(true[r[1]] - r[2]) < 1e-12 for r in found if r[1] in true)
    assert hits >= 0.93 * 20 * len(want)


def test_small_tables_are_exact(spark):
    rows = sample(30)
    want = brute(rows, 40) | brute(rows[:7], 40, 15)
    got = search(spark, rows, 40)
    got.setdefault(100, [])  # the only vector of its length
    assert {q: [r[1] for r in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert search(spark, rows[:4]) == {} and search(spark, []) == {}
    assert search(spark, [(20, [1.0] * 16, "")]) == {}


def test_shards():
    sizes = np.array([5, ann.SHARD, 3 * ann.SHARD + 1, 0, 7])
    first, many = ann.shards_of(sizes)
    assert many.tolist() == [1, 1, 4, 1, 1]
    assert first.tolist() == [0, 1, 2, 6, 6]


def test_rows_of_one_id_and_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16 if i % 3 else 5).tolist(), "") for i in range(1, 90)]
    rows += [(40, rng.normal(size=16).tolist(), ""), (40, rows[39][1], ""), (41, rows[40][1], "")]
    want = []
    vectors = [np.array(v, dtype=np.float32).astype(np.float64) for _, v, _ in rows]
    for at, (q, _, _) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-float((vectors[at] * v).sum()), rows[i][0], i) for i, v in enumerate(vectors) if i != at and len(v) == len(vectors[at]))
            want += [(q, rank, i, round(-s, 9)) for rank, (s, i, _) in enumerate(near[:10], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, asks string")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.search(frame, F.expr("vec_id % 20 = 0"), 10).collect()]
    assert sorted(got) == sorted(want)


def test_many_neighbours(spark):
    rows = sample(900, 3)
    want, got = brute(rows, 300), search(spark, rows, 300)
    hits = sum(len({r[1] for r in got[q]} & {i for _, i in want[q]}) for q in want)
    assert all(len(got[q]) == 300 for q in want) and hits >= 0.9 * 300 * len(want)
