"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, mixing, pii, piece_bpe, quality, secrets, simhash, substring_dedup, vector_dedup
from .common import prepare, table


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


#: Key of the registered pseudonym query; a deployment passes its own.
PII_KEY = b"reelforge registered query"


def op2_pii(spark: SparkSession, sf_dir: str, key: bytes = PII_KEY) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), key)
    return found.select("doc_id", "text", *[count_kind(pii.SPANS, kind) for kind in ("email", "ip", "phone", "card", "iban", "ssn", "date")])


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(tokens: DataFrame) -> DataFrame:
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return digests(piece_bpe.tokenise(table(spark, sf_dir, "documents"), model_path or tokenizer_path()))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.remainder() == 2, F.lit(False))
    model = langid.fit(docs.filter(~held_out))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, most=3)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "random"))
    return found.select("doc_id", *[count_kind("base", kind) for kind in ("assign", "access", "hex")], F.sha2(secrets.text_of("base"), 256).alias("base_sha256"), secrets.text_of(every).alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(prepare(spark), sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter("quality is not null")
    good = labels.filter("quality = 1")
    share = good.count() / max(1, labels.count())  # as many as the labels call good
    return quality.select(table(spark, sf_dir, "documents"), good.select("doc_id"), share)


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ann, op2_pii, op3_sentencepiece, op4_substring_dedup, op5_langid, op6_mixing, op7_secrets, op8_simhash, op9_quality, op10_vector_dedup)}

#: The same results where SQL can express them: every window and every pair.
ORACLES: dict[str, str] = {
    "op4_substring_dedup": r"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS word FROM listed),
starts AS (SELECT doc_id, i, word, CASE WHEN count(*) OVER w = 35 THEN string_agg(word, ' ') OVER w END AS passage
    FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
repeated AS (SELECT passage FROM starts WHERE passage IS NOT NULL GROUP BY passage HAVING count(*) > 1),
marked AS (SELECT doc_id, i, word, coalesce(bool_or(r.passage IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
    FROM starts s LEFT JOIN repeated r ON s.passage = r.passage),
sums AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT l.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM listed l LEFT JOIN sums USING (doc_id)""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(sid - 1) % 3 + 1] AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM src),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
c AS (SELECT *, cap * rest <= (total - before) * weight AS capped FROM o),
t AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)))::DOUBLE / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target, CAST(greatest(1, least(4096, total // 100000)) AS BIGINT) AS common FROM c),
u AS (SELECT *, CASE WHEN target < common * 64 THEN 1::BIGINT << (length(bin(greatest(1, CAST(floor(target / 64) AS BIGINT)))) - 1) ELSE common END AS b FROM t),
m AS (SELECT *, CAST(round(sum(CAST(round(target * 1024) AS BIGINT)) OVER (PARTITION BY b) / 1024 / b) AS BIGINT) AS blocks, CAST(greatest(1, least(4096, ceil(docs / 2000.0))) AS INT) AS shards FROM u),
q AS (SELECT sid, blocks, row_number() OVER (PARTITION BY b ORDER BY target / (2 * k + 1) DESC, sid, k) AS r FROM (SELECT *, unnest(range(0, CAST(2 * target / b AS BIGINT) + 60)) AS k FROM m WHERE target > 0)),
seats AS (SELECT sid, count(*) AS seats FROM q WHERE r <= blocks GROUP BY sid),
placed AS (SELECT m.sid, CAST(('0x' || substring(md5('42:shard:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % shards AS INT) AS shard, doc_id, size, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
cells AS (SELECT p.sid, shard, CAST(sum(size) AS BIGINT) AS words, any_value(m.b) AS b, any_value(source_size) AS source_size, any_value(target) AS target, any_value(coalesce(seats, 0)) AS source_seats FROM placed p JOIN m ON p.sid = m.sid LEFT JOIN seats s ON p.sid = s.sid GROUP BY p.sid, shard),
q2 AS (SELECT sid, shard, source_seats, row_number() OVER (PARTITION BY sid ORDER BY words / (2 * k + 1) DESC, shard, k) AS r FROM (SELECT *, unnest(range(0, CAST(2.0 * source_seats * words / source_size AS BIGINT) + 60)) AS k FROM cells WHERE words > 0)),
seats2 AS (SELECT sid, shard, count(*) AS seats FROM q2 WHERE r <= source_seats GROUP BY sid, shard),
quotas AS (SELECT c.*, least(coalesce(seats, 0) * b, 3 * words) AS quota, CASE WHEN words > 0 THEN least(coalesce(seats, 0) * b, 3 * words) // words ELSE 0 END AS passes FROM cells c LEFT JOIN seats2 USING (sid, shard)),
rests AS (SELECT *, quota - passes * words AS left_over FROM quotas),
cut AS (SELECT *, unnest(range(0, (words - 1) // b + 1)) AS number FROM rests WHERE left_over > 0),
sized AS (SELECT *, least(b, words - number * b) AS length FROM cut),
ranked AS (SELECT *, sum(length) OVER (PARTITION BY sid, shard ORDER BY md5('42:block:' || sid || ':' || shard || ':' || number), number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length AS filled FROM sized),
chosen AS (SELECT sid, shard, number, number * b AS lo, number * b + least(length, left_over - filled) AS hi FROM ranked WHERE filled < left_over),
laid AS (SELECT *, CAST(sum(size) OVER (PARTITION BY sid, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop FROM placed),
spans AS (SELECT l.*, stop - size AS start, b FROM laid l JOIN cells USING (sid, shard)),
covering AS (SELECT sid, shard, start, stop, unnest(range(start // b, (stop - 1) // b + 1)) AS number FROM spans WHERE size > 0),
extra AS (SELECT sid, shard, start, sum(greatest(0, least(stop, hi) - greatest(start, lo))) AS extra FROM covering JOIN chosen USING (sid, shard, number) GROUP BY sid, shard, start)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, r.source_size, r.target, CAST(CASE WHEN s.size > 0 THEN r.passes * s.size + coalesce(extra, 0) ELSE 0 END AS BIGINT) AS taken
FROM spans s JOIN rests r USING (sid, shard) LEFT JOIN extra e ON s.sid = e.sid AND s.shard = e.shard AND s.start = e.start""",
    "op10_vector_dedup": r"""
WITH RECURSIVE sound AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lows AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, least(e.vec_id, coalesce(low, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN lows ON lows.a = e.vec_id""",
}
