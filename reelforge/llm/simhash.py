"""SimHash near-duplicates joined by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The perfect
binary Golay code [23, 12, 7] maps every 23-bit word to one codeword at distance
3 or less.  An *index* row carries the codeword of a segment; a *query* row
carries the codewords of the segment and of its 23 one-bit neighbours (1 or 6
of them), so two segments that differ in at most one bit always meet.

Three bit errors over three segments leave two segments with at most one error
each (two such errors in two segments would make four).  So the pairs
    (golay 1, golay 2)                           catch errors spread over 1 and 2,
    (exact a, golay 3) and (golay a, exact 3)    catch the rest, for a in 1, 2:
if segment 1 or 2 has two errors or more, the other two have one error together.
Every pair at distance 3 or less is therefore found; the rest is removed by the
verification.

For looser links, those of texts with enough shingles in common, the fingerprint
is wider: ``WORDS`` words of 64 bits from independently mixed shingle hashes, cut
into sixteen segments of 23 bits.  Texts with a Jaccard similarity of 0.8 differ in
15 % of all bits, 3.5 in a segment; errors are spread, so some of the sixteen have
few, and such a segment meets in a common codeword (two in five do at 0.8).  A key
is the codeword together with the smallest shingle hash under the segment's seed,
so that a passage that a third of all documents share doesn't gather them in one
bucket.  One key in common makes a pair a candidate if the first two words differ
in ``CANDIDATE_BITS`` or less; 99 % of the pairs at 0.8 are.

``keep_one`` then gathers the shingle sets of each candidate group, in a grid of
bounded blocks if it is large, and links two texts if the Jaccard similarity of
their sets is high enough.  Two similar sets share one of the rarest shingles of
each, which spares most comparisons.

Buckets are matched in bounded blocks and give spanning forests, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, partitions, prepare, text_key
from .graph import components

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code.
GOLAY_POLY = 0b101011100011
#: Segments as (shift, bits).
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Words of the wide fingerprint, and its segments.
WORDS = 6
WIDE = WORDS * 64 // 23
#: Index rows of one key that one block may hold.
BLOCK = 4096
#: Differing bits of a candidate among 128: at Jaccard 0.8, 19 are expected, give or take 4.
CANDIDATE_BITS = 36
#: Shingles in one part of a candidate group, and the rows up to which a block compares all its pairs.
PART_SHINGLES = 1 << 20
FEW = 16
#: Pairs that a kernel compares at once.
PAIRS = 1 << 20
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    return x ^ (x >> np.uint64(31))


def golay_decoder() -> np.ndarray:
    """For each 23-bit word the index (0..4095) of its nearest codeword."""
    info = np.arange(4096, dtype=np.uint32)
    code = np.zeros(4096, dtype=np.uint32)
    for bit in range(12):  # multiples of the generator polynomial
        code ^= np.where(info >> bit & 1, np.uint32(GOLAY_POLY << bit), np.uint32(0))
    out = np.zeros(1 << 23, dtype=np.uint16)
    flips = [0] + [1 << i for i in range(23)]
    flips += [1 << i | 1 << j for i in range(23) for j in range(i)]
    flips += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    for flip in flips:
        out[code ^ np.uint32(flip)] = info
    return out


_DECODER: list[np.ndarray] = []


def decoder() -> np.ndarray:
    if not _DECODER:
        _DECODER.append(golay_decoder())
    return _DECODER[0]


def near_codes(segment: np.ndarray, bits: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) for all distinct codewords within one flipped bit."""
    table = decoder()
    around = np.stack([table[segment]] + [table[segment ^ np.uint32(1 << i)] for i in range(bits)], axis=1)
    around.sort(axis=1)
    first = np.ones(around.shape, dtype=bool)
    first[:, 1:] = around[:, 1:] != around[:, :-1]
    row, column = np.nonzero(first)
    return row, around[row, column]


def segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.uint32) for shift, bits in SEGMENTS]


def _pack(family: int, *parts: np.ndarray) -> np.ndarray:
    key = np.full(parts[0].shape, family, dtype=np.uint64)
    for part in parts:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
    return key


def fuzzy_keys(fp: np.ndarray, wide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, is_query) of all keys of the fingerprints.

    wide: None, or (rows, 2 k): k smallest hashes, then the k segments.
    """
    every = np.arange(len(fp))
    rows, keys, sides = [], [], []

    def put(row, key, query):
        rows.append(row)
        keys.append(key)
        sides.append(np.full(len(row), query, dtype=bool))

    table = decoder()
    if wide is not None:
        half = wide.shape[1] // 2
        for k in range(half):
            segment = wide[:, half + k].astype(np.uint32)
            row, code = near_codes(segment)
            put(every, _pack(16 + k, wide[:, k], table[segment]), False)
            put(row, _pack(16 + k, wide[row, k], code), True)
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)
    parts = segments(fp)
    plain = [table[part] for part in parts]
    near = [near_codes(part) for part in parts]
    put(every, _pack(0, plain[0], plain[1]), False)
    (row0, code0), (row1, code1) = near[0], near[1]
    counts = np.bincount(row1, minlength=len(fp))
    starts = np.cumsum(counts) - counts
    repeat = counts[row0]  # each code of segment 1 with all of segment 2
    row = np.repeat(row0, repeat)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    put(row, _pack(0, np.repeat(code0, repeat), code1[starts[row] + inner]), True)
    for a in (0, 1):
        put(every, _pack(1 + a, parts[a], plain[2]), False)
        row, code = near[2]
        put(row, _pack(1 + a, parts[a][row], code), True)
        put(every, _pack(3 + a, plain[a], parts[2]), False)
        row, code = near[a]
        put(row, _pack(3 + a, code, parts[2][row]), True)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of the words, A-Z in lower case."""
    if text is None:
        return np.zeros(0, dtype=np.uint64)
    parts = text.encode().lower().split()  # bytes: only A-Z change
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed=42)], dtype=np.uint64)
    joined, n = b" ".join(parts), len(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=n) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], 42) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)),
        dtype=np.uint64,
        count=n - words + 1,
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; none: zero."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


_SEEDS = mix64(np.arange(1, max(WORDS, WIDE) + 1, dtype=np.uint64))


def wide_print(hashes: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The words of the wide fingerprint; smallest hashes, then segments."""
    ones = np.zeros((WORDS, 64), dtype=np.int64)
    low = np.full(WIDE, np.iinfo(np.uint64).max if len(hashes) else 0, dtype=np.uint64)
    for at in range(0, len(hashes), 1 << 13):
        part = hashes[at : at + (1 << 13)]
        mixed = mix64(part[None, :] + _SEEDS[:WORDS, None])
        mixed[0] = part
        bits = np.unpackbits(mixed.astype("<u8", copy=False).view(np.uint8).reshape(WORDS, len(part), 8), axis=2, bitorder="little")
        ones += bits.sum(axis=1, dtype=np.uint16)
        low = np.minimum(low, mix64(part[None, :] ^ _SEEDS[:WIDE, None]).min(axis=1))
    bits = np.packbits((ones * 2 > len(hashes)).astype(np.uint8), axis=1, bitorder="little")
    whole = int.from_bytes(bits.tobytes(), "little")
    cut = [whole >> 23 * k & (1 << 23) - 1 for k in range(WIDE)]
    return bits.view("<u8").ravel().tolist(), np.concatenate([low, np.array(cut, dtype=np.uint64)])


def _fingerprints(shingle: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            fps, more = np.zeros((2, len(texts)), dtype=np.uint64)
            wides = np.zeros((len(texts), 2 * WIDE), dtype=np.uint64)
            nodes = np.zeros(len(texts), dtype=np.uint64)
            sizes = np.zeros(len(texts), dtype=np.int64)
            for i, text in enumerate(texts):
                hashes = shingle_hashes(text, shingle)
                if not wide:
                    fps[i] = fingerprint(hashes)
                    continue
                hashes = np.unique(hashes)
                nodes[i], sizes[i] = xxhash.xxh64_intdigest(hashes.tobytes()), len(hashes)
                (fps[i], more[i], *_), wides[i] = wide_print(hashes)
            columns = [batch.column("doc_id"), pa.array(fps.view(np.int64))]
            names = ["doc_id", "fp"]
            if wide:
                columns += [pa.array(more.view(np.int64)), pa.array(list(wides.view(np.int64)), type=pa.list_(pa.int64())), pa.array(nodes.view(np.int64)), pa.array(sizes), batch.column("text")]
                names += ["more", "wide", "node", "size", "text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, wide: bool = False) -> DataFrame:
    """doc_id, fp long (the unsigned bits) and, if asked for, what keys need.

    ``wide`` counts a repeated shingle once and adds ``more`` (the second word of
    the wide fingerprint), ``wide`` (smallest hashes and segments), ``node`` (a
    hash of the set of shingles), ``size`` (their number) and the text.  A null
    or wordless text has fingerprint zero.
    """
    schema = "doc_id long, fp long" + (", more long, wide array<long>, node long, size long, text string" if wide else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(shingle, wide), schema)


def _emit(wide: bool, with_queries: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            low, words = None, [fp.view(np.int64)]
            if wide:
                low = batch.column("wide").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(fp), -1)
                words.append(batch.column("more").to_numpy(zero_copy_only=False))
            row, key, query = fuzzy_keys(fp, low)
            if not with_queries:
                row, key, query = row[~query], key[~query], query[~query]
            for at in range(0, len(row), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[part].view(np.int64)), pa.array(query[part]), *[pa.array(w[row[part]]) for w in words]], names=["key", "query", "fp", "more"][: 2 + len(words)]
                )

    return run


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> (node, smallest node of its component), the latter left out."""
    if not len(u):
        return u, v
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _match(max_bits: int):
    """Sorted by (key, block, query): index rows of a bucket, then its queries."""

    def pairs(words: list[np.ndarray], i_start, i_count, q_start, q_count):
        """Linked pairs of buckets given by their ranges, in bounded chunks."""
        size = i_count * q_count
        bounds = np.concatenate([[0], np.cumsum(size)])
        total = int(bounds[-1])
        for at in range(0, total, PAIRS):
            flat = np.arange(at, min(at + PAIRS, total))
            bucket = np.searchsorted(bounds, flat, side="right") - 1
            inner = flat - bounds[bucket]
            i, j = i_start[bucket] + inner % i_count[bucket], q_start[bucket] + inner // i_count[bucket]
            differ = np.zeros(len(flat), dtype=np.int64)
            for word in words:
                differ += np.bitwise_count(word[i] ^ word[j])
            x, y = words[0][i], words[0][j]
            near = (differ <= max_bits) & (x != y)
            yield local_forest(x[near].view(np.int64), y[near].view(np.int64))

    def solve(key, block, query, *words):
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(key)))
        asked = np.add.reduceat(query.astype(np.int64), start)
        useful = (asked > 0) & (asked < count)
        start, count, asked = start[useful], count[useful], asked[useful]
        if len(start):
            yield from pairs(words, start, count - asked, start + count - asked, asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now[3:] = [word.view(np.uint64) for word in now[3:]]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            key, block = held[:2]
            if not len(key):
                continue
            last = int(np.flatnonzero((key != key[-1]) | (block != block[-1]))[-1]) + 1 if ((key != key[-1]) | (block != block[-1])).any() else 0
            if last < (1 << 15) and len(key) - last < 8 * BLOCK:
                continue  # gather more before working
            for u, v in solve(*(x[:last] for x in held)):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            held = [x[last:] for x in held]
            if len(held[0]) >= 8 * BLOCK:  # a bucket with many queries: its index rows stay
                for u, v in solve(*held):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                held = [x[~held[2]] for x in held]
        if held is not None and len(held[0]):
            for u, v in solve(*held):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def linked(spark: SparkSession, prints: DataFrame, max_bits: int, wide: bool = False) -> DataFrame:
    """Distinct fingerprints -> (u, v) edges whose components are those of all
    links that share a key (without ``wide`` and for 3 bits: of all links).

    Hot keys (more than BLOCK index rows) are dealt as a grid of blocks: index
    rows by hash to a row of the grid, queries by hash to a column, and each
    side is copied along the other, so that all pairs still meet.
    """
    words = ["fp", "more"] if wide else ["fp"]
    schema = "key long, query boolean, " + ", ".join(f"{w} long" for w in words)
    source = prints.select(*words, "wide") if wide else prints.select("fp")
    rows, index = (source.mapInArrow(_emit(wide, queries), schema) for queries in (True, False))
    scratch = Scratch(spark, "simhash")
    hot = scratch.put(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("side")))
    side = F.coalesce("side", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), side).cast("int")
    every = F.when(side == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), side - 1))
    dealt = (
        rows.join(hot, "key", "left")
        .select("key", "query", *words, own.alias("own"), side.alias("side"), F.explode(every).alias("other"))
        .select("key", "query", *words, F.when(F.col("query"), F.col("other") * F.col("side") + F.col("own")).otherwise(F.col("own") * F.col("side") + F.col("other")).alias("block"))
    )
    n = partitions(spark)
    return (
        dealt.repartition(n, "key", "block")
        .sortWithinPartitions("key", "block", "query")
        .select("key", "block", "query", *words)
        .mapInArrow(_match(max_bits), "u long, v long")
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links).

    Fingerprints link at ``max_bits`` or fewer differing bits: exactly for 3 or
    less.  Texts that are null or wordless have fingerprint zero and link like
    any other.  Rows may repeat.  A null doc_id is never a component's id unless
    alone.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "near-duplicates")
    each = scratch.put(fingerprints(docs, shingle))
    prints = scratch.put(each.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = components(spark, linked(spark, prints, max_bits))
    member = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    member = scratch.put(member)
    lows = scratch.put(member.groupBy("label").agg(F.min("low").alias("component_id")))
    member = scratch.put(member.join(lows, "label").select("fp", "component_id"))
    return each.select("doc_id", "fp").join(member, "fp").select("doc_id", "fp", "component_id")


def similar_forest(sets: list[np.ndarray], part: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) whose components are those of all pairs with a Jaccard of
    ``similarity`` or more; where parts differ, of all pairs across parts.

    With shingles ordered from rare to common, sets that similar share one of
    the first n - ceil(similarity * n) + 1 of each.  Pairs that are connected
    already aren't compared.
    """
    m = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=m)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    _, token, frequency = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    crossed = part.min() != part.max()
    label, marked, links = np.arange(m), np.zeros(len(frequency), dtype=bool), []
    if m > FEW:
        owner = np.repeat(np.arange(m), sizes)
        order = np.lexsort((token, frequency[token], owner))
        first = np.arange(len(token)) - bounds[owner] < (sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1)[owner]
        first &= frequency[token[order]] > 1
        rare, holder = token[order][first], owner[first]
        starts = np.searchsorted(holder, np.arange(m + 1))
        by_token = np.argsort(rare, kind="stable")
        posted, posting = rare[by_token], holder[by_token]
        lo, hi = np.searchsorted(posted, rare), np.searchsorted(posted, rare, side="right")
    for i in range(m - 1):
        if m > FEW:
            near = np.zeros(m, dtype=bool)
            for at in range(starts[i], starts[i + 1]):
                near[posting[lo[at] : hi[at]]] = True
            near[: i + 1] = False
        else:
            near = np.arange(m) > i
        near &= (label != label[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9)
        if crossed:
            near &= part != part[i]
        others = np.flatnonzero(near)
        if not len(others):
            continue
        marked[token[bounds[i] : bounds[i + 1]]] = True
        n = sizes[others]
        ends = np.cumsum(n)
        flat = np.arange(ends[-1]) + np.repeat(bounds[others] - ends + n, n)
        common = np.add.reduceat(marked[token[flat]].astype(np.int64), ends - n)
        marked[token[bounds[i] : bounds[i + 1]]] = False
        for j in others[common / (sizes[i] + n - common) >= similarity].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((i, j))
    return links


def _verify(shingle: int, similarity: float):
    """Sorted by (label, block): the texts of a block of a candidate group."""

    def solve(rows):
        nodes = np.array([r[0] for r in rows], dtype=np.int64)
        links = similar_forest([r[2] for r in rows], np.array([r[1] for r in rows]), similarity)
        u, v = (np.array([x[k] for x in links], dtype=np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for label, block, part, node, text in zip(*(batch.column(n).to_pylist() for n in ("label", "block", "part", "node", "text")), strict=True):
                if (label, block) != now:
                    if len(rows) > 1:
                        yield solve(rows)
                    now, rows = (label, block), []
                rows.append((node, part, np.unique(shingle_hashes(text, shingle))))
        if len(rows) > 1:
            yield solve(rows)

    return run


def similar(spark: SparkSession, each: DataFrame, groups: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v) edges between nodes; their components are those of all pairs of
    one candidate group (``groups``: fp, label) with enough similarity.

    A group of more than PART_SHINGLES is cut into parts, and every two parts
    (and each by itself) meet in a block.
    """
    scratch = Scratch(spark, "similar")
    nodes = each.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size")).join(groups, "fp", "left").select("node", "size", F.coalesce("label", "fp").alias("label"))
    nodes = scratch.put(nodes)
    large = nodes.groupBy("label").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / PART_SHINGLES).cast("int").alias("side")).filter("n > 1").select("label", "side")
    large = scratch.put(large)  # with a known size, so that a hot group needn't be dealt by label
    member = scratch.put(nodes.join(large, "label").select("node", "label", "side"))
    part = F.pmod(F.xxhash64("node"), F.col("side")).cast("int")
    texts = each.groupBy("node").agg(F.min("text").alias("text")).join(member, "node").withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    dealt = texts.withColumn("other", other).select("label", (F.least("part", "other") * F.col("side") + F.greatest("part", "other")).cast("long").alias("block"), "part", "node", "text")
    return dealt.repartition(partitions(spark), "label", "block").sortWithinPartitions("label", "block").mapInArrow(_verify(shingle, similarity), "u long, v long")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Documents with one of each near-duplicate group kept.

    Texts link when the Jaccard similarity of their sets of shingles reaches
    ``similarity``; SimHash only finds the candidates.  Kept is the text with the
    smallest doc_id of its group (a null one last, ties to the smaller hash of
    the text).  Rows that repeat both doc_id and text share their fate; other
    texts under the same doc_id are documents of their own.  Texts without words
    aren't compared and stay.  All columns stay, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "keep-one")
    worded = docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    each = scratch.put(fingerprints(worded, shingle, True).withColumn("text_key", text_key()))
    prints = scratch.put(each.select("fp", "more", "wide").distinct())
    groups = components(spark, linked(spark, prints, CANDIDATE_BITS, True)).withColumnRenamed("node", "fp")
    labels = components(spark, similar(spark, each, groups, shingle, similarity))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    found = each.select("doc_id", "text_key", "node").distinct().join(labels, "node", "left").select(rank.alias("rank"), F.coalesce("label", "node").alias("label"))
    found = scratch.put(found)
    lows = scratch.put(found.groupBy("label").agg(F.min("rank").alias("low"), F.count("*").alias("n")).filter("n > 1"))
    gone = found.join(lows, "label").filter(~F.col("rank").eqNullSafe(F.col("low"))).select("rank.doc_id", "rank.text_key").distinct()
    gone = scratch.put(gone)
    key, own = fresh(docs, "text_key", "gone_id")
    gone = gone.select(F.col("doc_id").alias(own), F.col("text_key").alias(key))
    left = docs.withColumn(key, text_key()).alias("doc").join(gone.alias("gone"), F.col(f"doc.{key}").eqNullSafe(F.col(f"gone.{key}")) & F.col("doc.doc_id").cast("long").eqNullSafe(F.col(f"gone.{own}")), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
