"""Language identification, words first with backoff to shorter character n-grams.

A model holds log frequencies per language of frequent words and of character
n-grams (4 to 1, over the word between spaces).  A known word counts with its
own log frequencies; an unseen one with the mean over its known 4-grams, without
any of those over its 3-grams, and so on.  The language with the greatest sum
wins, ties to the smaller name; the score is its softmax probability.

The model is fitted on a bounded sample: about ``sample`` documents of each
language, drawn by a hash of the doc_id, so that its size (``top`` grams of each
kind) doesn't depend on the data and it can be sent to the tasks.  Every
document is scored over its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, prepare

UNDETERMINED = "und"
ORDERS = (4, 3, 2, 1)
#: Words, and their characters, remembered from batch to batch.
CACHE, CACHE_CHARS = 300_000, 1 << 24
_LETTERS = re.compile(r"[^\W\d_]+")


def remainder() -> Column:
    """crc32 of the doc_id as text, modulo 4."""
    return F.crc32(F.col("doc_id").cast("string")) % 4


def grams(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Rows of ``weights`` are log frequencies per language."""

    languages: list[str]
    place: dict[tuple[int, str], int]  # (0, word) or (n, n-gram)
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.by_kind: dict[int, dict[str, int]] = {kind: {} for kind in (0, *ORDERS)}
        for (kind, gram), at in self.place.items():
            self.by_kind[kind][gram] = at

    def rows(self, word: str) -> list[int]:
        """Rows of a word by backoff: its own, or those of its longest known grams."""
        at = self.by_kind[0].get(word)
        if at is not None:
            return [at]
        for n in ORDERS:
            known = self.by_kind[n]
            found = [known[g] for g in grams(word, n) if g in known]
            if found:
                return found
        return []

    def word(self, word: str) -> np.ndarray | None:
        """Log frequencies of one word, None if nothing is known."""
        return self.words([word])[0] if self.rows(word) else None

    def words(self, words: list[str]) -> np.ndarray:
        """Log frequencies of words, the mean over their rows; 0 if nothing is known."""
        rows = [self.rows(w) for w in words]
        count = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat = np.fromiter((at for r in rows for at in r), dtype=np.int64, count=int(count.sum()))
        out = np.zeros((len(words), len(self.languages)))
        if len(flat):
            known = np.flatnonzero(count)
            starts = (np.cumsum(count) - count)[known]
            out[known] = np.add.reduceat(self.weights[flat], starts, axis=0) / count[known, None]
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word, n in Counter(_LETTERS.findall((text or "").lower())).items():
                seen[lang, 0, word] += n
                for order in ORDERS:
                    for gram in grams(word, order):
                        seen[lang, order, gram] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array([k[2] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
            names=["lang", "kind", "gram", "n"],
        )


def fit(labelled: DataFrame, sample: int = 1500, top: int = 60_000, least: int = 2) -> Model:
    """A model from doc_id, text and lang; rows with a null among them don't count.

    sample: documents of each language to fit on, in expectation.
    top: grams of each kind to keep, most frequent first; least: their minimum.
    """
    prepare(labelled.sparkSession)
    usable = labelled.filter("doc_id is not null and text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, np.zeros((0, 0)))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / sizes[lang]))])
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    counted = drawn.select("lang", "text").mapInArrow(_count, "lang string, kind int, gram string, n long").groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))
    wide = counted.groupBy("kind", "gram").agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"_{i}") for i, lang in enumerate(languages)])
    wide = Scratch(labelled.sparkSession, "langid").put(wide.filter(F.col("total") >= least))
    rows = []
    for kind in (0, *ORDERS):  # each task keeps its own first ones, so that no task reads all grams
        rows += wide.filter(F.col("kind") == kind).orderBy(F.desc("total"), "gram").limit(top).collect()
    rows.sort(key=lambda r: (r["kind"], r["gram"]))
    place = {(r["kind"], r["gram"]): i for i, r in enumerate(rows)}
    counts = np.array([[r[f"_{i}"] for i in range(len(languages))] for r in rows], dtype=np.float64).reshape(len(rows), len(languages))
    kinds = np.array([r["kind"] for r in rows], dtype=np.int64)
    weights = np.zeros_like(counts)
    for kind in np.unique(kinds):  # add half an occurrence to each
        own = kinds == kind
        weights[own] = np.log((counts[own] + 0.5) / (counts[own].sum(axis=0) + 0.5 * own.sum()))
    return Model(languages, place, weights)


class Scorer:
    """Scores texts; remembers the words it has met, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.languages)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.table = np.zeros((0, self.width))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.width:
            return langs, scores
        if len(self.place) > CACHE or self.chars > CACHE_CHARS:
            self.clear()
        place = self.place
        fresh = list({w for ws in words for w in ws if w not in place})
        if fresh:
            self.chars += sum(map(len, fresh))
            place.update(zip(fresh, range(len(place), len(place) + len(fresh)), strict=True))
            self.table = np.concatenate([self.table, self.model.words(fresh)])
        for i, ws in enumerate(words):
            if not ws or not (ws[0].isalpha() or any(map(str.isalpha, texts[i]))):
                continue
            at = np.fromiter(map(place.__getitem__, ws), dtype=np.int64, count=len(ws))
            total = self.table[at].sum(axis=0)
            best = int(total.argmax())
            langs[i], scores[i] = self.model.languages[best], 1 / np.exp(total - total[best]).sum()
        return langs, scores


def _score(model, keep: list[str], added: list[str]):
    """model: broadcast, so that an executor gets it once and not with each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            langs, scores = scorer.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, *added])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row's whole text.

    ``und`` with score 0 for a text that is null or has no letter, and for all
    if the model has no language.  Letters that the model has never seen count
    for nothing.  Repeated rows give repeated results.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(sent, ["doc_id"], ["lang_pred", "score"]), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5, **bounds) -> DataFrame:
    """Documents whose language is determined with a score of ``least`` or more.

    All columns stay, whatever their names; a null ``lang`` becomes the prediction.  The model is
    fitted on the labelled rows of the same table.  One pass, no join.
    """
    model, names, added = fit(docs, **bounds), docs.columns, fresh(docs, "lang_pred", "lang_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.mapInArrow(_score(sent, names, added), schema).filter((F.col(added[0]) != UNDETERMINED) & (F.col(added[1]) >= least))
    return kept.withColumn("lang", F.coalesce("lang", added[0])).select(*[F.col(f"`{c}`") for c in names])
