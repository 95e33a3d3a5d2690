"""Two-pass external shuffle: seeded hashes scatter rows into memory-sized buckets, each of which is shuffled and written."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import common as C

BUCKET_BYTES = 16 << 20
OWN = ("shard", "slot")


def shuffle_to_shards(docs: DataFrame, shards: int = 24, seed: int = 42, where: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes a uniform random permutation of docs, cut into shards of as many rows each (give or take one), and rereads it.

    First pass: a row's bucket is a seeded hash of its identifier, so buckets hold about bucket_bytes of text each, whatever the
    sources or copies, and whatever files docs is read from; a text longer than that has its bucket's room besides. Second pass: within a bucket rows are put in the order of the hash and Fisher-Yates shuffled by a
    generator seeded with (seed, bucket), so a retried task writes the same rows; bucket sizes, summed before, give each row
    its place in the whole. The result has the columns of docs, without any that are called shard or slot, and those two:
    slot counts from 0 without gaps. Null identifiers are scattered by their text; rows that agree in both stay together.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    where = where or C.scratch(spark, "shards")
    kept = [c for c in docs.columns if c.lower() not in OWN]
    n_buckets = max(1, -(-C.text_bytes(docs) // bucket_bytes))
    key, bucket, many, start = C.free(docs, "_h", "_bucket", "_n", "_start")
    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    rows = docs.select(*kept).withColumn(key, h).withColumn(bucket, F.pmod(key, F.lit(n_buckets)))
    counts = C.materialize(rows.groupBy(bucket).agg(F.count("*").alias(many)), "buckets")
    total = counts.agg(F.sum(many)).first()[0] or 0
    starts = C.prefix_sums(counts, bucket, many, start).drop(many)
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffled(t: pa.Table) -> pa.Table:
        rng = np.random.Generator(np.random.PCG64([seed, t.column(bucket)[0].as_py()]))
        order = np.argsort(t.column(key).to_numpy(), kind="stable")
        rng.shuffle(order)  # Fisher-Yates
        place = t.column(start)[0].as_py() + np.arange(len(order))
        shard = place * shards // total
        out = t.select(kept).take(pa.array(order))
        return out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(place - -(-shard * total // shards)))

    rows = C.wide(rows.join(starts, bucket), bucket, n_buckets // 2).groupBy(bucket).applyInArrow(C.tidied(shuffled), schema)
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(where)
    return spark.read.schema(schema).parquet(where)


def shard_digest(docs: DataFrame, shards: int = 24, seed: int = 42) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return shuffle_to_shards(docs.select("doc_id", "text"), shards, seed).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
