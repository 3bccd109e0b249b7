"""Mixing of sources to target weights by Sainte-Lague apportionment.

DataFrame operations only.  Blocks of equally many words are dealt to sources by
the highest quotients target / (2k + 1), then in the same way to the shards of
each source by shard / (2k + 1), which gives every shard an integer quota.
Sources whose target has fewer than ``LEAST_BLOCKS`` such blocks are dealt smaller
ones (a power of two of words, down to one), each size of block among its sources,
so that a long tail of small sources stays in the mix of a large table.  A
shard lays its documents on a line in seeded order, cut into blocks; a quota of
several lines takes whole passes, and its rest the blocks that come first in a
seeded order.

All (2k + 1) quotients are never listed: the seats of a party differ from
votes / block by less than its share of half the number of parties, so a few
candidates around that value decide, about five for each party.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, prepare, text_key

#: The mix has about this many blocks, of at most MOST_WORDS words.
BLOCKS = 100_000
MOST_WORDS = 4096
#: A source's target has this many blocks or more, or blocks of one word.
LEAST_BLOCKS = 64
#: Documents for each shard, and shards of one source at most.
SHARD_DOCS = 2000
MOST_SHARDS = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def drawn(prefix: str, *columns: str) -> Column:
    """md5 of a prefix and values, as text to order by; a null is an empty text."""
    return F.md5(F.concat(F.lit(prefix), F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """sid, weight, target from (source, source_size): caps fill like water.

    Sources in order of cap / weight are capped as long as the level that would
    use up the total with all later ones lies above their cap.
    """
    listed = F.array(*[F.lit(w) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("sid", F.row_number().over(order)).withColumn("weight", F.element_at(listed, (F.col("sid") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    all_ = Window.partitionBy(F.lit(0))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "sid")
    ranked = ranked.withColumns(
        {
            "total": F.sum("source_size").over(all_) * share,
            "before": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "rest": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("capped", F.col("cap") * F.col("rest") <= (F.col("total") - F.col("before")) * F.col("weight"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(all_)
    used = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_), F.lit(0))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("total") - used) / free)
    return ranked.withColumn("target", target).select("sid", "source", "source_size", "docs", "total", "target")


def seats(parties: DataFrame, votes: str, number: str, groups: list[str], tie: str) -> DataFrame:
    """Adds ``seats``: ``number`` seats of each group by the highest quotients."""
    group = Window.partitionBy(*groups)
    share = F.when(F.col("_sum") > 0, F.col(votes) / F.col("_sum")).otherwise(0.0)
    about = F.floor(share * F.col(number))
    slack = F.ceil(share * F.col("_parties")) + 2
    ready = (
        parties.withColumns({"_sum": F.sum(votes).over(group), "_parties": F.count("*").over(group)})
        .withColumns({"_low": F.greatest(F.lit(0), about - slack).cast("long"), "_high": (about + slack).cast("long")})
        .withColumn("_left", F.col(number) - F.sum("_low").over(group))
    )
    columns = parties.columns
    rivals = ready.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("_q"), tie, "_k"))
    won = rivals.withColumn("_won", (rank <= F.col("_left")) & (F.col(votes) > 0))
    return won.groupBy(*columns).agg((F.min("_low") + F.count_if("_won")).cast("long").alias("seats"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Sources stand by code point with null last; their weights repeat
    ``weights``.  The mix has ``share`` of all words; no source (and no
    document) is taken more than ``most`` times.  A null text has size 0 and is
    never taken, an empty table gives an empty mix; repeated rows are dealt like
    different documents.  The same rows and seed give the same result.
    """
    return _dealt(docs, weights, share, most, seed).select("doc_id", "size", "source_size", "target", "taken")


def _dealt(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int) -> DataFrame:
    """The mix with the source and shard of each row."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "mixing")
    sized = scratch.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), text_key().alias("text_key")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    aimed = targets(sources, weights, share, most)
    aimed = aimed.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(MOST_WORDS), F.floor(F.col("total") / BLOCKS))).cast("long"))
    fine = F.expr(f"shiftleft(1L, length(bin(greatest(1L, cast(floor(target / {LEAST_BLOCKS}) as bigint)))) - 1)")
    aimed = aimed.withColumn("block", F.when(F.col("target") < F.col("block") * LEAST_BLOCKS, fine).otherwise(F.col("block")))
    words = F.sum(F.round(F.col("target") * 1024).cast("long")).over(Window.partitionBy("block")) / 1024  # whole numbers, in any order
    aimed = aimed.withColumn("blocks", F.round(words / F.col("block")).cast("long"))
    dealt = seats(aimed, "target", "blocks", ["block"], "sid").withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("docs") / SHARD_DOCS))).cast("int"))
    dealt = scratch.put(dealt.select("sid", "source", "source_size", "target", "block", "seats", "shards"))

    seeded = drawn(f"{seed}:", "doc_id")
    placed = sized.join(dealt.select(F.col("source").alias("_source"), "sid", "shards"), F.col("source").eqNullSafe(F.col("_source"))).select(
        "sid", (F.conv(F.substring(drawn(f"{seed}:shard:", "doc_id"), 1, 8), 16, 10).cast("long") % F.col("shards")).cast("int").alias("shard"), "doc_id", "text_key", "size", seeded.alias("seeded")
    )
    cells = placed.groupBy("sid", "shard").agg(F.sum("size").alias("words")).join(dealt.select("sid", "source", "block", "source_size", "target", F.col("seats").alias("source_seats")), "sid")
    cells = seats(cells, "words", "source_seats", ["sid"], "shard")
    quota = F.least(F.col("seats") * F.col("block"), F.col("words") * most)
    cells = cells.withColumn("quota", quota).withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("quota") / F.col("words"))).otherwise(0).cast("long"))
    cells = scratch.put(cells.withColumn("rest", F.col("quota") - F.col("passes") * F.col("words")).select("sid", "source", "shard", "words", "block", "source_size", "target", "passes", "rest"))

    line = Window.partitionBy("sid", "shard").orderBy("seeded", "doc_id", "size", "text_key")
    laid = placed.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    laid = scratch.put(laid.select("sid", "shard", "doc_id", "text_key", "size", "start", "end"))

    row = Window.partitionBy("sid", "shard").orderBy(drawn(f"{seed}:block:", "sid", "shard", "number"), "number")
    cut = cells.filter("rest > 0").withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / F.col("block")))))
    cut = cut.withColumn("length", F.least("block", F.col("words") - F.col("number") * F.col("block")))
    cut = cut.withColumn("before", F.sum("length").over(row.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    chosen = cut.filter("before < rest").select("sid", "shard", "number", (F.col("number") * F.col("block")).alias("from"), (F.col("number") * F.col("block") + F.least("length", F.col("rest") - F.col("before"))).alias("to"))
    covering = laid.filter("size > 0").join(cells.filter("rest > 0").select("sid", "shard", "block"), ["sid", "shard"])
    covering = covering.withColumn("number", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block")))))
    extra = covering.join(chosen, ["sid", "shard", "number"]).groupBy("sid", "shard", "start").agg(F.sum(F.greatest(F.lit(0), F.least("end", "to") - F.greatest("start", "from"))).alias("extra"))
    extra = extra.withColumn("size", F.lit(1))  # rows of size 0 share their start with the next one

    out = laid.join(cells.select("sid", "source", "shard", "source_size", "target", "passes"), ["sid", "shard"])
    out = out.join(extra.withColumnRenamed("size", "_one"), ["sid", "shard", "start"], "left")
    taken = F.when(F.col("size") > 0, F.col("passes") * F.col("size") + F.coalesce("extra", F.lit(0))).otherwise(0)
    return out.select("sid", "source", "shard", "doc_id", "text_key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 42) -> DataFrame:
    """The mix as documents: each row as often as its words were taken.

    A row whose words were taken m times over appears m times.  Parts of
    documents are added up along a shard from the longest document to the
    shortest, from a seeded start, and the document at which the sum passes a
    whole number appears once more: a shard's words stay within its longest
    document or so of those taken, and no document is favoured by its length.
    Rows of one source that repeat both doc_id and text are one document here;
    other texts under the same doc_id are documents of their own.  Wordless rows
    belong to no source's quota and go.  All columns stay, whatever their names.
    """
    key = ["sid", "source", "shard", "doc_id", "text_key"]
    taken = _dealt(docs, weights, share, most, seed).filter("size > 0").groupBy(*key).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    line = Window.partitionBy("sid", "shard").orderBy(F.desc("size"), drawn(f"{seed}:", "doc_id"), "doc_id", "text_key")
    start = F.conv(F.substring(drawn(f"{seed}:copies:", "sid", "shard"), 1, 8), 16, 10).cast("double") / 2.0**32
    taken = taken.withColumns({"whole": F.floor(F.col("taken") / F.col("size")), "begin": start})
    part = F.sum((F.col("taken") - F.col("whole") * F.col("size")) / F.col("size")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    passed = taken.withColumn("passed", F.floor(F.col("begin") + part))
    copies = F.col("whole") + F.col("passed") - F.lag("passed", 1, 0).over(line)
    own, of, told, times, copy = fresh(docs, "mix_id", "mix_source", "mix_text", "mix_times", "mix_copy")
    chosen = passed.select(F.col("doc_id").alias(own), F.col("source").alias(of), F.col("text_key").alias(told), copies.cast("int").alias(times)).filter(F.col(times) > 0)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & F.col("source").cast("string").eqNullSafe(F.col(of)) & (text_key() == F.col(told))
    joined = docs.join(chosen, same)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
