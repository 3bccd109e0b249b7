import random

import numpy as np
import xxhash

from reelforge.llm import graph, simhash

SCHEMA = "doc_id long, text string, extra string"


def brute(rows, shingle=3, bits=3):
    prints = {}
    for i, (_, text, *_) in enumerate(rows):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        grams = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, row in enumerate(rows):
        low[find(i)] = min(low.get(find(i), row[0]), row[0])
    return sorted((row[0], prints[i], low[find(i)]) for i, row in enumerate(rows))


def test_golay_neighbours_meet():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for _ in range(5):
        flips = np.zeros(300, dtype=np.uint64)
        for _ in range(3):
            flips |= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
        row, key, query = simhash.fuzzy_keys(fp)
        index = [set(key[(row == i) & ~query].tolist()) for i in range(300)]
        row, key, query = simhash.fuzzy_keys(fp ^ flips)
        assert all(index[i] & set(key[(row == i) & query].tolist()) for i in range(300))


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t ", "c"), (4, "One", "d"), (5, "one", "e"), (6, "É é", None)]
    for g in range(25):
        words = rng.choices(vocabulary, k=rng.choice([2, 3, 30, 400]))
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((100 + len(rows), " ".join(copy), "x"))
    rows.append(rows[-1])
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == brute(rows)


def test_hot_key_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = random.Random(5)
    base = rng.choices([f"w{i}" for i in range(500)], k=900)
    rows = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(900)] = f"e{i}"
        rows.append((i, " ".join(copy), ""))
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == brute(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keep_one(spark):
    rng = random.Random(6)
    words = rng.choices([f"w{i}" for i in range(500)], k=300)
    rows = [(9, " ".join(words), "a"), (3, " ".join(words[:150] + ["new"] + words[151:]), "b"), (5, " ".join(reversed(words)), "c"), (6, "", "d"), (7, None, "e")]
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "extra"]
    assert sorted(r.doc_id for r in got.collect()) == [3, 5, 6, 7]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(15)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (300, 200), (None, 5)]
    got = dict(map(tuple, graph.components(spark, spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(16)} | {100 + i: 100 for i in range(30)} | {200: 200, 300: 200}


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def kept_by_jaccard(rows):
    sets = [shingles(text) for _, text, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    low = {}
    for (doc, *_), r in zip(rows, root, strict=True):
        low[r] = min(low.get(r, doc), doc)
    return sorted(low.values())


def test_links_have_the_jaccard(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(100_000)}"
    rows = []
    put = lambda words: rows.append((len(rows), " ".join(words), ""))
    for n, step in ((200, 1), (40, 4), (9, 20)):
        for percent in range(40, 96, step):  # a shared passage of any length: Jaccard 0.4 to 0.95
            words = [word() for _ in range(n)]
            shared = round(2 * percent / (100 + percent) * n)
            put(words)
            put(words[:shared] + [word() for _ in range(n - shared)])
    for _ in range(60):  # short texts that share a shingle
        words = [word() for _ in range(rng.choice([5, 6, 7]))]
        put(words)
        put(words[:5] + [word()])
        put([*words, word()])
    for share in (100, 170, 185):  # a hot passage; only the longest makes its texts similar
        hot = [word() for _ in range(share)]
        for _ in range(60):
            put(hot + [word() for _ in range(200 - share)])
    put(rows[0][1].split() * 30)  # the same set of shingles but for those across the seam
    want = kept_by_jaccard(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == want
    monkeypatch.setattr(simhash, "PART_SHINGLES", 3000)  # groups dealt in parts
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == want


def test_recall_at_the_threshold(spark):
    """Candidates of pairs with a Jaccard of 0.8 to 0.83, in texts of many lengths."""
    rng = random.Random(12)
    rows, pairs = [], 0
    for n in (45, 100, 250, 800):
        made = 0
        while made < 60:
            words = [f"w{rng.randrange(100_000)}" for _ in range(n)]
            edited = list(words)
            for at in rng.sample(range(n), k=max(1, round(n * 0.021) + rng.randrange(2))):
                edited[at] = "x"
            a, b = shingles(" ".join(words)), shingles(" ".join(edited))
            if 0.8 <= len(a & b) / len(a | b) <= 0.83:
                made += 1
                rows += [(len(rows), " ".join(words), ""), (len(rows) + 1, " ".join(edited), "")]
        pairs += made
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).count()
    assert len(rows) - kept >= 0.95 * pairs


def test_one_id_on_two_texts_and_clashing_columns(spark):
    rng = random.Random(13)
    one, two = (" ".join(f"w{rng.randrange(1000)}" for _ in range(60)) for _ in range(2))
    rows = [(1, one, 1, 1, 1), (2, one, 2, 2, 2), (2, two, 3, 3, 3), (None, one, 4, 4, 4), (None, two + " x", 5, 5, 5), (3, "same", 6, 6, 6), (3, "same", 7, 7, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _gone int, text_key int, gone_id int")
    got = simhash.keep_one(frame)
    assert got.columns == frame.columns
    assert sorted(r._gone for r in got.collect()) == [1, 3, 6, 7]
