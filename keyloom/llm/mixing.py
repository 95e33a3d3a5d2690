"""Mixing sources to target weights by hash-random keys, prefix sums and exact cuts; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.llm import common as C

#: Rows of a source in one range of its keys, and the most sources whose plan is broadcast (about 100 bytes each).
RANGE_ROWS, BROADCAST_SOURCES = 2_000, 50_000
KEY_BITS = 52


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def hash_key(seed: int) -> Column:
    """52 random bits that follow from a row's identifier and text, so reruns and other layouts agree."""
    parts = [F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sources (skey, source, source_size, n_rows) with target: share of all sizes by weight, none above most times its source's size, the excess reshared by weight."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("_w", w).withColumn("_cap", most * F.col("source_size").cast("double")).withColumn("_all", share * F.sum("source_size").over(W.partitionBy()).cast("double"))
    by = W.orderBy(F.col("_cap") / F.col("_w"), "skey")
    before, rest = F.sum("_cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.sum("_w").over(by.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("_level", (F.col("_all") - F.coalesce(before, F.lit(0.0))) / rest).withColumn("_rank", F.row_number().over(by))
    level = F.min_by(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level")), F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_rank"))).over(W.partitionBy())
    return s.withColumn("target", F.when(level.isNull(), F.col("_cap")).otherwise(F.least("_cap", level * F.col("_w")))).select("skey", "source_size", "n_rows", "target")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """docs with size (words), source_size, target (of its source) and taken (words of it that the mix holds).

    Sources in order of code points, null last, get the weights in turn. A source's whole epochs are taken first; what is left
    of its budget goes to its documents in the order of hash-random keys, found by sums over ranges of keys and by an exact
    cut within one range, in which the last document gives only what is missing. So the hottest source's rows are spread over ranges, and the
    text is never shuffled. Rows of one identifier and text share a key and, at the cut, what is left. Null or empty texts have
    size 0 and give nothing; input columns of the added names are replaced; an empty table gives no rows.
    """
    spark = docs.sparkSession
    added = {"size", "source_size", "target", "taken"}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in added])
    skey = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    sized = C.materialize(docs.select("source", skey.alias("skey"), n_words(F.col("text")).alias("size"), hash_key(seed).alias("key")), "sizes")
    targets = C.materialize(source_targets(sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), weights, share, most), "targets")
    budget = F.round("target").cast("long")
    t = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)).withColumn("left", budget - F.col("whole") * F.col("source_size")).withColumn("n_ranges", F.ceil(F.col("n_rows") / RANGE_ROWS))
    few = targets.count() <= BROADCAST_SOURCES
    side = F.broadcast if few else (lambda x: x)
    ranged = sized.where("size > 0").join(side(t), "skey").withColumn("range", F.floor(F.col("key").cast("double") / float(1 << KEY_BITS) * F.col("n_ranges")))
    sums = ranged.groupBy("skey", "range", "left").agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("skey").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut_in = sums.withColumn("_before", before).where((F.col("left") > 0) & (F.col("_before") < F.col("left")) & (F.col("_before") + F.col("_sum") >= F.col("left"))).select("skey", "range", "_before")
    inner = ranged.join(side(cut_in), ["skey", "range"]).groupBy("skey", "left", "_before", "key").agg(F.sum("size").alias("_own"), F.count("*").alias("_same"))
    upto = F.col("_before") + F.sum("_own").over(W.partitionBy("skey").orderBy("key").rowsBetween(W.unboundedPreceding, 0))
    cuts = inner.withColumn("_upto", upto).where((F.col("_upto") >= F.col("left")) & (F.col("_upto") - F.col("_own") < F.col("left"))).select("skey", F.col("key").alias("cut"), F.floor((F.col("left") - F.col("_upto") + F.col("_own")) / F.col("_same")).alias("cut_size"))
    plan = C.materialize(t.join(cuts, "skey", "left").select(F.col("skey").alias("_skey"), "source_size", "target", F.col("whole").alias("_whole"), F.col("cut").alias("_cut"), F.col("cut_size").alias("_cut_size")), "mix")
    key = F.col("_key")
    part = F.when(key < F.col("_cut"), F.col("size")).when(key == F.col("_cut"), F.least("size", "_cut_size")).otherwise(0)
    full = docs.withColumns({"size": n_words(F.col("text")), "_key": hash_key(seed), "_skey": skey}).join(F.broadcast(plan) if few else plan, "_skey")
    return full.withColumn("taken", (F.col("_whole") * F.col("size") + part).cast("long")).drop("_skey", "_whole", "_cut", "_cut_size", "_key")


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix as documents: one taken up to once is there once, one taken up to twice is there twice, and so on; the rest go."""
    n = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.where("taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), n))).drop("_copy", "size", "source_size", "target", "taken")


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
