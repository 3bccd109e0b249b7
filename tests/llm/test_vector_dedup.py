import numpy as np
import pytest

from reelforge.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, least=0.98):
    def sound(v, label):
        return v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    vs = [np.array(v, dtype=np.float32).astype(np.float64) if sound(v, label) else None for _, v, label, *_ in rows]
    for i in range(n):
        for j in range(i):
            a, b = vs[i], vs[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], low[find(i)], low[find(i)] == rows[i][0]) for i in range(n))


def sample(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(1, None, 1, ""), (2, [0.0] * 8, 1, ""), (3, [float("nan")] + [1.0] * 7, 1, ""), (4, [None] + [1.0] * 7, 1, ""), (5, [1.0] * 8, None, ""), (6, [1.0] * 8, 2, ""), (7, [2.0] * 8, 2, ""), (8, [float("inf")] * 8, 2, ""), (9, [], 2, ""), (10, [1.0] * 7, 2, "")]
    centres = rng.normal(size=(12, 8))
    while len(rows) < n:
        c = centres[rng.integers(12)]
        v = rng.normal(size=8) if rng.random() < 0.3 else c + rng.normal(size=8) * rng.choice([0.0, 0.01, 0.1, 0.2])
        rows.append((100 + 7 * (len(rows) * 31 % 997), (v * rng.choice([1, 3])).tolist(), int(rng.integers(3)), ""))
    return rows


def got(spark, rows):
    return sorted(map(tuple, vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_matches_brute_force(spark):
    rows = sample(400)
    assert sum(r[1] > 0 for r in brute(rows)) > 100
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [2, 25])
def test_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "VISITORS", 4 * block)
    monkeypatch.setattr(vector_dedup, "CHUNK", 100)
    rows = sample(300, 4)
    assert got(spark, [*rows, rows[-1]]) == brute([*rows, rows[-1]])


def test_dense_spots_and_pivots(spark, monkeypatch):
    """Two tight balls, a looser one at their fringe, and noise in one label."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 20)
    rng = np.random.default_rng(8)
    near = rng.normal(size=16)
    near /= np.linalg.norm(near)
    other = near + rng.normal(size=16) * 0.06
    rows = [(i, (c + rng.normal(size=16) * s).tolist(), 1, "") for i, (c, s) in enumerate([(near, 0.015)] * 120 + [(other, 0.01)] * 90 + [(near, 0.05)] * 90 + [(np.zeros(16), 1.0)] * 200)]
    want = brute(rows)
    assert max(r[1] for r in want) > 150 and sum(0 < r[1] < 60 for r in want) > 20
    assert got(spark, rows) == want


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_collinear_at_the_threshold(spark, monkeypatch, block):
    """Scaled copies of one vector, and vectors at cosine 0.98 give or take 1e-8 to it."""
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    v, w = np.eye(4)[0], np.eye(4)[1]
    rows = [(i, (2.0 ** (i - 16) * v).tolist(), 1, "") for i in range(33)]
    rows += [(100 + i, (c * v + np.sqrt(1 - c * c) * w).tolist(), 1, "") for i, c in enumerate((0.98 - 1e-8, 0.98 + 1e-8))]
    schema = SCHEMA.replace("float", "double")
    found = dict((r[0], r[1:]) for r in map(tuple, vector_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()))
    assert [found[i][:2] for i in range(33)] == [(33, 0)] * 33
    assert found[100] == (1, 0, False) and found[101] == (34, 0, False)


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0], 1, ""), (1, [0.0, 1.0], 1, ""), (2, [1.0, 0.01], 1, "")]
    assert got(spark, rows) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_tree_covers_and_nests():
    points = np.random.default_rng(0).normal(size=(200, 5))
    tree = vector_dedup.CoverTree(points / np.linalg.norm(points, axis=1)[:, None])
    assert sorted(tree.order.tolist()) == list(range(200))
    for node, children in enumerate(tree.children):
        members = tree.members(node)
        assert np.linalg.norm(tree.points[members] - tree.points[tree.centre[node]], axis=1).max() <= tree.radius[node] + 1e-7
        if len(children):
            assert tree.centre[node] in [tree.centre[c] for c in children]
            assert all(tree.radius[c] <= tree.radius[node] / 2 + 1e-9 for c in children)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(4, [1.0, 2.0], 1, ""), (3, [2.0, 4.0], 1, "")]) == [(3, 1, 3, True), (4, 1, 3, False)]
