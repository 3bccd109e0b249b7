"""A training corpus from raw documents: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelforge.llm import langid, mixing, pii, piece_bpe, simhash
from reelforge.llm.common import Scratch, prepare
from reelforge.llm.queries import PII_KEY, tokenizer_path


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing ``lang`` is filled in."""
    return langid.keep_identified(docs, least=0.5)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in the text."""
    return pii.pseudonymise(docs, PII_KEY, spans=False)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions; some documents repeat, some go."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with an end id, and the text that they decode to."""
    tokens = piece_bpe.tokenise(docs, tokenizer_path())
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", identify),
    ("SimHash near-dedup", deduplicate),
    ("PII", pseudonymise),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokenise),
]

#: The models and sketches of the stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    prepare(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
