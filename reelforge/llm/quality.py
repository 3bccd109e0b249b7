"""Quality selection by importance resampling.

Two generative models over hashed word and word-pair counts are fitted: one on
target texts, one on all texts.  The log ratio of a text's probabilities is its
importance weight; adding seeded Gumbel noise and taking the largest keys draws
without replacement in proportion to the weights (Gumbel top-k).

The counts cover every document.  Each task adds them up in one vector of
``buckets`` before anything is shuffled.  The target texts are those labelled
so, at most about ``sample`` of them (drawn by a hash), whose ids are sent to the
tasks.  The k-th largest key is found exactly by counting its 64 bits in four
steps of 16, so nothing is sorted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare
from .simhash import mix64

BUCKETS = 10_000
#: Target documents to fit on, in expectation.
SAMPLE = 20_000
#: Words, and runs of other marks.
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the tokens and of the pairs of neighbours, repeats included."""
    digest = xxhash.xxh64_intdigest
    tokens = _TOKENS.findall(text.lower()) if text else []
    one = np.fromiter(map(digest, tokens), dtype=np.uint64, count=len(tokens))
    two = mix64(one[:-1] * _PAIR + one[1:])
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text, own in zip(batch.column("text").to_pylist(), batch.column("is_target").to_pylist(), strict=True):
                counts = np.bincount(features(text, buckets), minlength=buckets)
                raw += counts
                if own:
                    target += counts
        if raw.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])

    return run


def fit(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket.

    targets: doc_id of target documents.  With no target, all ratios are 0.
    """
    ids = targets.filter("doc_id is not null").select("doc_id").distinct()
    share = min(1.0, sample / max(1, ids.count()))
    drawn = ids.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < share * 1_000_000).withColumn("is_target", F.lit(True))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id", "left")
    sums = marked.select("text", F.coalesce("is_target", F.lit(False)).alias("is_target")).mapInArrow(_count(buckets), "bucket int, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def ordered(keys: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order."""
    bits = (keys + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits ^ np.int64(-(2**63)), bits)


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    uniform = (mix64(mix64(ids.astype(np.uint64)) ^ np.uint64(seed)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((uniform + 0.5) / 2.0**53))


def _weigh(ratio: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, len(ratio)) for t in batch.column("text").to_pylist()]
            weight = np.array([ratio[f].sum() for f in found], dtype=np.float64)
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            key = weight + gumbel(ids, seed)
            empty = np.array([not len(f) for f in found], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(weight, mask=empty), pa.array(key, mask=empty), pa.array(ordered(key), mask=empty)], names=["doc_id", "log_weight", "sample_key", "place"]
            )

    return run


def kth_largest(places: DataFrame, k: int) -> tuple[int, int]:
    """(k-th largest place, how many rows with just that place to take)."""
    low, high, left = -(2**63), 2**63 - 1, k
    for shift in (48, 32, 16, 0):
        step = F.shiftright("place", shift)
        counts = places.filter(F.col("place").between(low, high)).groupBy(step.alias("step")).count().collect()
        for r in sorted(counts, key=lambda r: -r["step"]):
            if r["count"] >= left:
                low, high = r["step"] << shift, (r["step"] << shift) + (1 << shift) - 1
                break
            left -= r["count"]
    return low, left


def select(docs: DataFrame, targets: DataFrame, share: float, seed: int = 42, buckets: int = BUCKETS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, log_weight, sample_key, selected for every row.

    Selected are the ``share`` of all rows with the largest keys, exactly; rows
    with equal keys (repeats of a row) go by doc_id.  Texts that are null or
    have no token have null weights and are never selected.
    """
    spark = prepare(docs.sparkSession)
    ratio = fit(docs, targets, buckets, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weighed = Scratch(spark, "quality").put(rows.mapInArrow(_weigh(ratio, seed), "doc_id long, log_weight double, sample_key double, place long"))
    sizes = weighed.agg(F.count("*").alias("n"), F.count("place").alias("usable")).first()
    k = min(round(share * sizes["n"]), sizes["usable"])
    if not k:
        return weighed.select("doc_id", "log_weight", "sample_key", F.lit(False).alias("selected"))
    edge, ties = kth_largest(weighed, k)
    at_edge = weighed.filter(F.col("place") == edge).withColumn("selected", F.row_number().over(Window.orderBy("doc_id")) <= ties)
    rest = weighed.filter(~F.col("place").eqNullSafe(F.lit(edge))).withColumn("selected", F.coalesce(F.col("place") > edge, F.lit(False)))
    return rest.union(at_edge).select("doc_id", "log_weight", "sample_key", "selected")
