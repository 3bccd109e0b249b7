"""Approximate nearest neighbours: inverted file with product quantisation.

A row belongs to the cell of its nearest coarse centroid (of unit vectors); its
residual is coded by ``PARTS`` sub-quantisers.  A query probes its best cells by
inner product, scores their rows with asymmetric distance tables (the query's
exact inner products with every code word), and reranks the best exactly in
double precision on the original vectors.

Centroids and code books are fitted on a bounded sample of ``SAMPLE`` rows; so is
the number of probed cells, as the least one that holds ``SOUGHT`` of the true
neighbours of sample queries.  Every row is indexed.  Cells are packed into
shards of about ``SHARD`` rows, a larger cell split over several.  Only the codes
of a row travel to its shard, and a query to each shard that holds a cell it
probes; there the shard's codes stay while its queries stream past.  Their best
rows by the tables meet the original vectors in a join, for the exact rerank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, prepare
from .vectors import matrix, valid

SAMPLE = 16_384
PARTS = 32
WORDS = 256
ROUNDS = 8
#: Share of the sample's true neighbours that the probed cells must hold.
SOUGHT = 0.98
#: Candidates scored for each query at least, rows of a shard, and queries that
#: one group meets: the most, and the fewest when there are more tasks than work.
CANDIDATES = 1024
SHARD = 65_536
CHUNK = 65_536
LEAST_CHUNK = 64
#: Candidates of a query in a shard, and in all, that are reranked at most (more
#: for a large k): those below the k-th best by less than the tables' own error.
RERANK = 1024
#: Queries that a kernel scores at once.
BATCH = 64


def kmeans(points: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """At most k centroids (Lloyd), fewer if there are fewer points."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        at = nearest(points, centroids)
        count = np.bincount(at, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, at, points)
        centroids = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], centroids)
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int64)
    half = (centroids * centroids).sum(axis=1) / 2
    for at in range(0, len(points), 4096):
        out[at : at + 4096] = (points[at : at + 4096] @ centroids.T - half).argmax(axis=1)
    return out


@dataclass
class Quantiser:
    """centroids (cells, d); books (parts, words, d / parts); probes."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int
    slack: float = np.inf

    def pad(self, vectors: np.ndarray) -> np.ndarray:
        extra = -vectors.shape[1] % len(self.books)
        return np.pad(vectors, ((0, 0), (0, extra)))

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        return nearest(unit(vectors), self.centroids)

    def codes(self, vectors: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts = len(self.books)
        rest = self.pad(vectors - self.centroids[cell]).reshape(len(vectors), parts, -1)
        return np.stack([nearest(rest[:, m], self.books[m]) for m in range(parts)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, parts, words) inner products with the code words."""
        parts = self.pad(queries).reshape(len(queries), len(self.books), -1)
        return np.einsum("qmd,mwd->qmw", parts, self.books).astype(np.float32)

    def probed(self, queries: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """Mask of cells: the best ``probes``, more until they hold ``least`` rows."""
        order = np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        need = (held < least).sum(axis=1) + 1
        take = np.arange(len(self.centroids))[None, :] < np.maximum(self.probes, need)[:, None]
        mask = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(mask, order, take, axis=1)
        return mask


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def fit(sample: np.ndarray, rows: int, k: int) -> Quantiser:
    """A quantiser for ``rows`` rows from a sample of them."""
    cells = int(min(4096, max(16, 2 ** round(np.log2(max(1, rows)) / 2)), max(1, len(sample) // 8)))
    units = unit(sample)
    centroids = kmeans(units, cells)
    parts = min(PARTS, sample.shape[1])
    out = Quantiser(centroids, np.zeros((parts, 1, 1)), len(centroids))
    cell = out.cell(sample)
    rest = out.pad(sample - centroids[cell]).reshape(len(sample), parts, -1)
    books = [kmeans(rest[: SAMPLE // 2, m], WORDS, seed=m) for m in range(parts)]
    words = max(map(len, books))
    out.books = np.stack([np.concatenate([b, np.repeat(b[:1], words - len(b), axis=0)]) for b in books])
    # Where the true neighbours of sample queries lie among the cells' order.
    asked = np.unique(np.linspace(0, len(sample) - 1, min(256, len(sample))).astype(np.int64))
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k > 0:
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(sample[asked] @ centroids.T), axis=1, kind="stable"), axis=1)
        ranks = np.take_along_axis(place, cell[best], axis=1)
        out.probes = int(np.quantile(ranks, SOUGHT)) + 1
        # How far the tables are off for true neighbours.
        own = best.ravel()
        codes, tables = out.codes(sample[own], cell[own]), out.tables(sample[asked])
        who = np.repeat(np.arange(len(asked)), k)
        about = (sample[asked][who] * centroids[cell[own]]).sum(axis=1) + tables[who[:, None], np.arange(parts)[None, :], codes].sum(axis=1)
        out.slack = 3.0 * float(np.quantile(np.abs(about - np.take_along_axis(score, best, axis=1).ravel()), 0.9))
    return out


def shards_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each cell: small cells share one."""
    first, many, at, filled = [], [], 0, 0
    for size in sizes.tolist():
        parts = max(1, -(-size // SHARD))
        if filled and filled + size > SHARD:
            at, filled = at + 1, 0
        first.append(at)
        many.append(parts)
        if parts > 1:
            at, filled = at + parts, 0
        else:
            filled += size
    return np.array(first, dtype=np.int64), np.array(many, dtype=np.int64)


def _encode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("vector"))
            cell = model.value.cell(vectors)
            codes = model.value.codes(vectors, cell)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["row", "vec_id", "cell", "codes"])

    return run


def _route(model, sizes: np.ndarray, first: np.ndarray, many: np.ndarray):
    """Each query once for every shard that holds one of its probed cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = int((first + many).max())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                mask = model.value.probed(matrix(part.column("vector")), sizes, CANDIDATES)
                hit = np.zeros((part.num_rows, total + 1), dtype=np.int32)
                for step, sign in ((first, 1), (first + many, -1)):
                    for cell in range(len(sizes)):
                        hit[mask[:, cell], step[cell]] += sign
                row, shard = np.nonzero(np.cumsum(hit, axis=1)[:, :total] > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), part.column("row").take(pa.array(row)), part.column("vector").take(pa.array(row))], names=["shard", "row", "vector"]
                )

    return run


def best_of(line: np.ndarray, k: int, slack: float, most: int) -> np.ndarray:
    """Places of the k greatest finite scores, and of those within ``slack`` of
    the k-th, ``most`` in all; ties to the first places."""
    seen = int((line > -np.inf).sum())
    keep = min(k, seen)
    if keep:
        kth = np.partition(line, len(line) - keep)[len(line) - keep]
        keep = min(seen, max(keep, min(most, int((line >= kth - slack).sum()))))
    if not keep:
        return np.zeros(0, dtype=np.int64)
    edge = np.partition(line, len(line) - keep)[len(line) - keep]
    above = np.flatnonzero(line > edge)
    return np.concatenate([above, np.flatnonzero(line == edge)[: keep - len(above)]])


def _search(model, sizes: np.ndarray, k: int):
    """Sorted by (shard, chunk, codes before queries, vec_id): a shard's codes
    stay, its queries stream past; the best candidates of each by the tables."""
    schema = pa.schema([("asker", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("about", pa.float32())])
    most, slack = max(RERANK, 2 * k), model.value.slack

    class Shard:
        def __init__(self, parts: list[pa.RecordBatch]):
            part = pa.Table.from_batches(parts)
            self.row, self.vec_id = part.column("row").to_numpy(), part.column("vec_id").to_numpy()
            cell = part.column("cell").to_numpy()
            self.codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), dtype=np.uint8).reshape(len(cell), -1).T.copy()
            self.members = [(c, np.flatnonzero(cell == c)) for c in np.unique(cell).tolist()]
            self.place = np.argsort(self.row, kind="stable")
            self.sorted = self.row[self.place]

        def answer(self, part: pa.RecordBatch) -> pa.RecordBatch:
            q, asker = matrix(part.column("vector")), part.column("row").to_numpy()
            mask, near, tables = model.value.probed(q, sizes, CANDIDATES), q @ model.value.centroids.T, model.value.tables(q)
            score = np.full((len(q), len(self.row)), -np.inf, dtype=np.float32)
            for c, own in self.members:
                who = np.flatnonzero(mask[:, c])
                if len(who):
                    total = np.repeat(near[who, c][:, None], len(own), axis=1).astype(np.float32)
                    for m, code in enumerate(self.codes):
                        total += tables[who, m][:, code[own]]
                    score[np.ix_(who, own)] = total
            at = np.minimum(np.searchsorted(self.sorted, asker), len(self.sorted) - 1)
            self_ = np.flatnonzero(self.sorted[at] == asker)  # a query isn't its own candidate
            score[self_, self.place[at[self_]]] = -np.inf
            best = [best_of(line, k, slack, most) for line in score]
            flat = np.concatenate(best)
            who = np.repeat(np.arange(len(q)), [len(b) for b in best])
            return pa.RecordBatch.from_arrays([pa.array(asker[who]), pa.array(self.row[flat]), pa.array(self.vec_id[flat]), pa.array(score[who, flat])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            group = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("shard", "chunk", "asks")])
            cuts = (np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                key = tuple(group[:2, start].tolist())
                if key != now:
                    now, held, shard = key, [], None
                if not group[2, start]:
                    held.append(batch.slice(start, end - start))
                    continue
                if shard is None and held:
                    shard, held = Shard(held), []
                for at in range(start, end if shard else start, BATCH):
                    yield shard.answer(batch.slice(at, min(BATCH, end - at)))

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact inner product of each candidate with its query."""
    for batch in batches:
        if batch.num_rows:
            score = (matrix(batch.column("vector")) * matrix(batch.column("asking"))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("asker"), batch.column("query_id"), batch.column("vec_id"), batch.column("row"), pa.array(score)], names=["asker", "query_id", "vec_id", "row", "score"])


def _search_length(spark: SparkSession, scratch: Scratch, sound: DataFrame, n: int, k: int) -> DataFrame:
    """asker, query_id, vec_id, row, score of reranked candidates; vectors of one length."""
    drawn = sound.select("vector", F.xxhash64("row").alias("h")).orderBy("h").limit(SAMPLE).select("vector").toArrow()
    fitted = fit(matrix(drawn.column("vector")), n, k)
    model = spark.sparkContext.broadcast(fitted)  # at most 4096 centroids and PARTS books
    index = scratch.put(sound.mapInArrow(_encode(model), "row long, vec_id long, cell int, codes binary"))
    sizes = np.zeros(len(fitted.centroids), dtype=np.int64)
    for r in index.groupBy("cell").count().collect():  # at most 4096 cells
        sizes[r["cell"]] = r["count"]
    first, many = shards_of(sizes)
    asking = sound.filter("asks")
    shards, asked = int((first + many).max()), max(1, asking.count())
    chunks = max(-(-asked // CHUNK), min(-(-asked // LEAST_CHUNK), -(-2 * partitions(spark) // shards)))
    start, parts = F.array(*[F.lit(int(x)) for x in first]), F.array(*[F.lit(int(x)) for x in many])
    shard = (start[F.col("cell")] + F.pmod(F.xxhash64("row"), parts[F.col("cell")])).cast("int")
    codes = index.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("asks"), "row", "vec_id", "cell", "codes", F.lit(None).cast(sound.schema["vector"].dataType).alias("vector"))
    routed = asking.select("row", "vector").mapInArrow(_route(model, sizes, first, many), sound.select(F.lit(0).alias("shard"), "row", "vector").schema)
    chunk = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int")
    queries = routed.select("shard", chunk.alias("chunk"), F.lit(True).alias("asks"), "row", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("int").alias("cell"), F.lit(None).cast("binary").alias("codes"), "vector")
    dealt = codes.unionByName(queries).repartition(partitions(spark), "shard", "chunk").sortWithinPartitions("shard", "chunk", "asks", "vec_id", "row")
    found = dealt.mapInArrow(_search(model, sizes, k), "asker long, row long, vec_id long, about float")
    order = Window.partitionBy("asker").orderBy(F.desc("about"), "vec_id", "row")
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(RERANK, 2 * k))
    kth = F.max(F.when(F.col("place") == k, F.col("about"))).over(Window.partitionBy("asker"))
    found = found.withColumn("kth", kth).filter((F.col("place") <= k) | F.col("kth").isNull() | (F.col("about") >= F.col("kth") - F.lit(fitted.slack)))
    near = scratch.put(found.select("asker", "row"))
    asking = asking.select(F.col("row").alias("asker"), F.col("vec_id").alias("query_id"), F.col("vector").alias("asking"))
    pairs = near.join(sound.select("row", "vec_id", "vector"), "row").join(asking, "asker")
    return pairs.select("asker", "query_id", "vec_id", "row", "vector", "asking").mapInArrow(_exact, "asker long, query_id long, vec_id long, row long, score double")


def search(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query.

    rows: vec_id and embedding; ``is_query`` tells the queries among them.  Near
    is a large inner product; ties go to the smaller vec_id.  Vectors that are
    null, zero or hold null or non-finite components take no part, nor do rows
    without a vec_id.  Vectors of one length are searched among themselves (an
    index for each length).  Rows that repeat a vec_id are candidates and queries
    of their own, and a query leaves out only its own row.  Other columns are
    ignored.
    """
    spark = prepare(rows.sparkSession)
    scratch = Scratch(spark, "ann")
    sound = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sound = scratch.put(sound.filter(F.col("vec_id").isNotNull() & valid("vector")).withColumn("row", F.monotonically_increasing_id()))
    lengths = sound.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).filter("asks > 0").orderBy("length").collect()
    found = None
    for of in lengths:  # as many as there are lengths of vectors
        part = _search_length(spark, scratch, sound.filter(F.size("vector") == of["length"]), of["n"], k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
