"""A corpus from raw documents to packed sequences, in five stages, each on what its predecessor kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import common, jaccard, mixing, packing, quality, suffix
from keyloom.llm.queries import documents, word_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.select("*", *common.row_key())


def _released(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, begun when executors have given back what the stage before has left."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark)
        return stage(spark, docs, sf_dir)

    return run


@_released
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and lie in their language's perplexity band."""
    gone = quality.score_quality(docs).where("not kept").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_k"), F.col("text_hash").alias("_h"))
    return _keyed(docs).join(gone, ["_k", "_h"], "left_anti").select(*COLUMNS)


@_released
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest identifier, of each group linked by five-word shingles at a similarity of 0.8."""
    first = jaccard.jaccard_components(docs, 5, 80, 100).where("is_first").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_k"), F.col("text_hash").alias("_h"))
    return _keyed(docs).join(first, ["_k", "_h"], "left_semi").dropDuplicates(["_k", "_h"]).select(*COLUMNS)


@_released
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier text, or an earlier place of the text, has within 100 bytes; a character of which a
    byte goes, goes; texts of which nothing but white space stays go. Rows that agree in identifier and text keep what the first of
    them keeps."""
    cut = suffix.drop_repeats(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_k"), F.col("text_hash").alias("_h"), F.octet_length("kept").alias("_n"), F.when(F.octet_length("kept") < F.col("n_bytes"), F.col("kept")).alias("kept"))
    cut = cut.groupBy("_k", "_h").agg(F.max_by("kept", "_n").alias("kept")).where("kept is not null")  # whole texts are null here and not shuffled
    rest = _keyed(docs).join(cut.select("_k", "_h", "kept").mapInArrow(_decode, "_k long, _h long, _kept string"), ["_k", "_h"], "left")
    n = F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("_kept")).cast("long")
    rest = rest.withColumns({"n_chars": n, "text": F.coalesce("_kept", "text")})
    return rest.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def _decode(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.record_batch({"_k": b.column("_k"), "_h": b.column("_h"), "_kept": pa.array([x.decode(errors="ignore") for x in b.column("kept").to_pylist()], pa.string())})


@_released
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights; a document of a second epoch is there twice."""
    return mixing.repeated(mixing.mix(docs)).select(*COLUMNS)


@_released
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_digest(docs, word_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("packed_sequences", packed_sequences),
]

#: Perplexity, components and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        mark = len(common.made)
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        *own, after = common.made[mark:]
        for path in [*own, *([before] if before else [])]:  # only what the next stage reads is kept
            common.discard(spark, path)
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
