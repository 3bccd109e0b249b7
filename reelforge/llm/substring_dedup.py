"""Repeated passages found with a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words.  Of the word grams inside a window the
one with the smallest hash (leftmost among equals) is its *anchor*.  Equal
windows have equal anchors at the same place, so only anchors are indexed, about
one for every fourteen words: a *posting* (document, anchor place, first and
last window it serves) with the gram's hash ``g`` and the hash ``span`` of all
words its windows cover.

Index: each batch of documents becomes an immutable run of (g, span, n), one row
for each distinct pair, in buckets of g sorted by g and span.  A new batch is
merge-joined with the runs of earlier ones, its doubtful windows are verified,
and then its run is compacted with them: runs of one level are merge-joined into
one of the next.  Buckets have one sorted file each, so these joins neither
shuffle nor sort.  Runs are plain folders; a manifest names the current ones,
so that a later session opens the index and goes on with the next batch.

Decision for a batch, exact up to 128-bit collisions (of its windows and of the
earlier ones that they meet):
  * a posting whose g occurs once has no repeated window;
  * if its (g, span) occurs again, all its windows are repeated ("settled");
  * otherwise, only if its g occurs again, its windows are verified one by one:
    their hashes are compared with those of the other open postings of that g
    and of one representative of each settled pair.
A passage that very many documents share is thus one row of the index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, prepare, text_key
from .simhash import mix64

WINDOW = 35
GRAM = 8
#: Runs of one level that are merged into one of the next.
FANOUT = 2
#: Odd factors of the rolling hashes; one less than each is twice an odd number.
FACTORS = (np.uint64(0x9E3779B97F4A7C17), np.uint64(0xD1342543DE82EF97))
_COEFFICIENTS = mix64(np.arange(11, 11 + GRAM, dtype=np.uint64)) | np.uint64(1)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the end)."""
    words = [t.encode().split() if t else [] for t in texts]
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for ws in words for w in ws), dtype=np.uint64, count=int(bounds[-1])), bounds


class Rolling:
    """Hashes of any word ranges from prefix sums, modulo 2**64."""

    def __init__(self, hashes: np.ndarray, factor: np.uint64):
        n = len(hashes) + 1
        power = np.full(n, factor, dtype=np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        back = np.full(n, np.uint64(pow(int(factor), -1, 1 << 64)), dtype=np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(hashes * self.power[:-1], dtype=np.uint64)])

    def range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.back[start])


def anchors(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, first window, last window, g, span); words count per text."""
    starts = [np.arange(a, b - WINDOW + 1) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if b - a >= WINDOW]
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, none
    start = np.concatenate(starts)
    count = len(hashes) - GRAM + 1
    gram = np.zeros(count, dtype=np.uint64)
    for j in range(GRAM):
        gram += hashes[j : j + count] * _COEFFICIENTS[j]
    gram = mix64(gram)
    low, width, wide = np.arange(count), 1, WINDOW - GRAM + 1
    while 2 * width <= wide:
        a, b = low[:-width], low[width:]
        low = np.where(gram[a] <= gram[b], a, b)
        width *= 2
    a, b = low[start], low[start + wide - width]
    anchor = np.where(gram[a] <= gram[b], a, b)
    text = np.searchsorted(bounds, start, side="right") - 1
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    place, lo, hi, text = anchor[first], start[first], start[last], text[first]
    span = Rolling(hashes, FACTORS[0]).range(lo, hi + WINDOW)
    span = mix64(span ^ (place - lo).astype(np.uint64) * _COEFFICIENTS[0] ^ (hi - lo).astype(np.uint64) * _COEFFICIENTS[1])
    base = bounds[text]
    return text, place - base, lo - base, hi - base, gram[place], span


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, place, lo, hi, gram, span = anchors(*word_hashes(batch.column("text").to_pylist()))
        if not len(text):
            continue
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(text)), batch.column("tkey").take(pa.array(text)), *[pa.array(x.astype(np.int32)) for x in (place, lo, hi)], pa.array(gram.view(np.int64)), pa.array(span.view(np.int64))],
            names=["doc_id", "tkey", "place", "lo", "hi", "g", "span"],
        )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, text: rows with one doc_id and different texts differ."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tkey", text_key()).select("doc_id", "tkey", "text")


RUN = "g long, span long, n long, leader long"
POSTING = "doc_id long, tkey long, place int, lo int, hi int, g long, span long"
MANIFEST = "version int, buckets int, levels array<array<string>>, batches array<string>"


class FingerprintIndex:
    """Sorted runs and postings in a folder that driver and executors share.

    Without ``path`` the index lives for one call.  With it, a later session
    goes on with the index that it finds there.  Each change is published by
    one row of the manifest before replaced runs are deleted, so a driver that
    dies leaves the last published state.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.scratch = prepare(spark), Scratch(spark, "fingerprints")
        self.root = (path or self.scratch.path()).rstrip("/")
        self.version, self.buckets, self.levels, self.batches = 0, partitions(spark), [[]], []
        if path:
            self._open()

    def _open(self) -> None:
        try:
            known = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as gone:
            if gone.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        for row in known.orderBy(F.desc("version")).limit(1).collect():
            self.version, self.buckets, self.levels, self.batches = row["version"], row["buckets"], row["levels"], row["batches"]

    def _publish(self) -> None:
        self.version += 1
        row = self.spark.createDataFrame([(self.version, self.buckets, self.levels, self.batches)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _new(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame) -> str:
        """Rows of a run, each bucket in one task, as a new folder."""
        run, name = self._new("run"), f"reelforge_{uuid.uuid4().hex}"
        try:
            with _bucketed_joins(self.spark):
                rows.write.bucketBy(self.buckets, "g").sortBy("g", "span").option("path", f"{self.root}/{run}").format("parquet").saveAsTable(name)
        finally:
            self.spark.sql(f"drop table if exists {name}")
        return run

    def _run(self, run: str) -> DataFrame:
        """A run as a bucketed frame.  Its name in the catalog is gone when this returns."""
        name, where = f"reelforge_{uuid.uuid4().hex}", f"{self.root}/{run}".replace("'", "\\'")
        try:
            self.spark.sql(f"create table {name} ({RUN}) using parquet clustered by (g) sorted by (g, span) into {self.buckets} buckets location '{where}'")
            return self.spark.table(name)
        finally:
            self.spark.sql(f"drop table if exists {name}")

    def _merge(self, left: DataFrame, right: DataFrame) -> str:
        """Two runs as one, by a merge join of their buckets."""
        left, right = left.alias("a"), right.alias("b")
        return self._write(
            left.join(right, (F.col("a.g") == F.col("b.g")) & (F.col("a.span") == F.col("b.span")), "full").select(
                F.coalesce("a.g", "b.g").alias("g"),
                F.coalesce("a.span", "b.span").alias("span"),
                (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"),
                F.least("a.leader", "b.leader").alias("leader"),
            )
        )

    def _batch(self, docs: DataFrame) -> tuple[str, str]:
        """Postings and run of a batch, written but not yet part of the index."""
        batch = self._new("postings")
        keyed(docs).mapInArrow(_postings, POSTING).write.parquet(f"{self.root}/{batch}")
        rows = self._postings_of([batch]).groupBy("g", "span").agg(F.count("*").alias("n"), F.min(_row_id()).alias("leader"))
        return batch, self._write(rows.repartition(self.buckets, "g"))

    def _postings_of(self, batches: list[str]) -> DataFrame:
        return self.spark.read.schema(POSTING).parquet(*[f"{self.root}/{b}" for b in batches])

    def _commit(self, batch: str, run: str) -> None:
        """The batch joins the index; levels with FANOUT runs are compacted."""
        levels, gone, level = [list(x) for x in self.levels], [], 0
        levels[0].append(run)
        while len(levels[level]) >= FANOUT:
            merged, *rest = levels[level]
            gone.append(merged)
            for other in rest:
                merged = self._merge(self._run(merged), self._run(other))
                gone += [other, merged]
            gone.pop()
            levels[level] = []
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(merged)
            level += 1
        self.levels, self.batches = levels, [*self.batches, batch]
        self._publish()
        for old in gone:
            self.scratch.drop(f"{self.root}/{old}")

    def add(self, docs: DataFrame) -> None:
        """Index a batch without asking for its repeated windows."""
        self._commit(*self._batch(docs))

    def dedup(self, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """doc_id, tkey, start, end: word ranges that repeated windows cover.

        Windows of the new batch that start elsewhere, in it or in earlier
        ones, and those of earlier documents that the batch repeats.  Ranges
        may overlap.  ``history``: the documents indexed before, read only where
        their windows must be verified.  Then the batch joins the index.
        """
        batch, run = self._batch(docs)
        mine, met = self._run(run), run
        for other in (r for level in self.levels for r in level):
            # grams of the batch in an earlier run, joined bucket by bucket
            last, met = met, self._merge(self._run(met), self._run(other).join(mine.select("g"), "g", "left_semi").select("g", "span", "n", "leader"))
            if last != run:
                self.scratch.drop(f"{self.root}/{last}")
        rows = self._run(met)
        with _bucketed_joins(self.spark):
            grams = rows.groupBy("g").agg(F.sum("n").alias("total"), F.min("n").alias("least")).filter("total > 1")
            status = self.scratch.put(rows.join(grams, "g").select("g", "span", "n", "leader", (F.col("least") == 1).alias("open")))
        if met != run:
            self.scratch.drop(f"{self.root}/{met}")
        hits = self._postings_of([*self.batches, batch]).join(status, ["g", "span"])
        hits = self.scratch.put(hits.select("doc_id", "tkey", "lo", "hi", "n", "open", (_row_id() == F.col("leader")).alias("leads")))
        settled = hits.filter("n > 1").select("doc_id", "tkey", F.col("lo").alias("start"), (F.col("hi") + WINDOW).alias("end"))
        asked = hits.filter("open and (n = 1 or leads)").select("doc_id", "tkey", "lo", "hi", (F.col("n") == 1).alias("own"))
        texts = keyed(docs) if history is None else keyed(history).union(keyed(docs))
        found = self.scratch.put(settled.union(self._verified(texts, asked)))
        self._commit(batch, run)
        return found

    def _verified(self, texts: DataFrame, asked: DataFrame) -> DataFrame:
        """Ranges of single windows that were verified to be repeated."""
        asked = self.scratch.put(asked.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("lo", "hi", "own")).alias("asked")))
        rows = _join(texts, asked, "inner").select("doc_id", "tkey", "text", "asked")
        windows = self.scratch.put(rows.mapInArrow(_windows, "doc_id long, tkey long, start int, own boolean, h1 long, h2 long"))
        again = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.bool_or("own").alias("any_own")).filter("n > 1 and any_own").select("h1", "h2")
        again = self.scratch.put(again)
        return windows.filter("own").join(again, ["h1", "h2"]).select("doc_id", "tkey", "start", (F.col("start") + WINDOW).alias("end"))


def _row_id():
    return F.xxhash64("doc_id", "tkey", "place")


@contextmanager
def _bucketed_joins(spark: SparkSession):
    """Let joins use the buckets of g, also on (g, span), and the order of their files."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    old = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def _join(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    other = other.withColumnsRenamed({"doc_id": "_id", "tkey": "_key"})
    return docs.join(other, docs["doc_id"].eqNullSafe(other["_id"]) & (docs["tkey"] == other["_key"]), how)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, bounds = word_hashes(batch.column("text").to_pylist())
        asked = batch.column("asked")
        per_text = np.diff(asked.offsets.to_numpy())
        flat = asked.flatten()
        lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        own = flat.field(2).to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(per_text)), per_text)
        size = hi - lo + 1
        start = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text, own = np.repeat(text, size), np.repeat(own, size)
        if not len(start):
            continue
        at = start + bounds[text]
        h = [Rolling(hashes, f).range(at, at + WINDOW).view(np.int64) for f in FACTORS]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(text)), batch.column("tkey").take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(own), *map(pa.array, h)],
            names=["doc_id", "tkey", "start", "own", "h1", "h2"],
        )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ranges = batch.column("text").to_pylist(), batch.column("ranges").to_pylist()
        kept, n_words, n_removed = [], [], []
        for text, found in zip(texts, ranges, strict=True):
            words = text.encode().split() if text else []
            out, at = [], 0
            for r in sorted(found or [], key=lambda r: r["start"]):
                if r["start"] > at:
                    out += words[at : r["start"]]
                at = max(at, r["end"])
            out += words[at:]
            kept.append(b" ".join(out).decode())
            n_words.append(len(words))
            n_removed.append(len(words) - len(out))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeated(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space).

    Every word covered by a window that also starts anywhere else goes, in all
    its places.  ``batches``: the documents enter the index in so many parts (by
    a hash of the doc_id), as they would day by day; the result doesn't depend
    on it.  A null text has no words; texts shorter than a window stay; rows
    that repeat a row are further places of its windows.
    """
    index = FingerprintIndex(docs.sparkSession)
    part, found = F.pmod(F.xxhash64("doc_id", F.lit("batch")), F.lit(batches)), None
    for k in range(batches):
        ranges = index.dedup(docs.filter(part == k), docs.filter(part < k) if k else None)
        found = ranges if found is None else found.union(ranges)
    return _without(docs, found, index.scratch)


def remove_in_batch(index: FingerprintIndex, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The columns of ``remove_repeated`` for a new batch, which then joins ``index``.

    Words go where a window also starts elsewhere in the batch or in an earlier
    one; earlier documents stay as they are.  ``history``: the documents indexed
    so far.  Null, short and repeated texts as in ``remove_repeated``.
    """
    return _without(docs, index.dedup(docs, history), index.scratch)


def _without(docs: DataFrame, ranges: DataFrame, scratch: Scratch) -> DataFrame:
    ranges = scratch.put(ranges.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("start", "end")).alias("ranges")))
    return _join(keyed(docs), ranges, "left").select("doc_id", "text", "ranges").mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")
