"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import common as C
from keyloom.llm.sstable import pack_ids, unpack_ids

#: Bytes of text whose pieces are packed together.
GROUP_BYTES = 24 << 20


@dataclass(frozen=True)
class Limits:
    """Of a sequence: tokens, segments (pieces in it) and loss-bearing tokens."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


def place(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> np.ndarray:
    """The bin of each item. A bin is opened and given, again and again, the fitting item of the largest dot product of its
    demands with the bin's free capacities (each as a share of its limit); when none fits, the next bin is opened. The
    fullest dimensions thus weigh least. Items of equal demands are alike, so one score is computed for each kind."""
    kinds, kind_of = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    if len(kinds) and (kinds[:, 0].max() > limits.tokens or kinds[:, 1].max() > limits.loss or limits.segments < 1):
        raise ValueError("an item exceeds a limit by itself")
    order = np.argsort(kind_of, kind="stable")
    next_ = np.searchsorted(kind_of[order], np.arange(len(kinds)))
    left = np.bincount(kind_of, minlength=len(kinds))
    t, q = kinds[:, 0].astype(np.int64), kinds[:, 1].astype(np.int64)
    cap = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    out, bin_, todo = np.zeros(len(tokens), np.int64), 0, len(tokens)
    live = np.arange(len(kinds))
    while todo:
        free = cap.copy()
        live = live[left[live] > 0]
        fits = live
        while free[1] >= 1:
            fits = fits[(t[fits] <= free[0]) & (q[fits] <= free[2]) & (left[fits] > 0)]
            if not len(fits):
                break
            score = t[fits] * (free[0] / cap[0] ** 2) + q[fits] * (free[2] / cap[2] ** 2)  # the segment's share is the same for all
            k = fits[int(np.argmax(score))]
            out[order[next_[k]]] = bin_
            next_[k] += 1
            left[k] -= 1
            todo -= 1
            free -= (t[k], 1, q[k])
        bin_ += 1
    return out


def pack_examples(pieces: DataFrame, limits: Limits = Limits(), groups: int = 1) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns tokens, loss, an integer key to deal them by, and any others).

    Pieces are dealt by a hash of key over so many groups, packed apart, so a hot source or group of copies spreads like any
    other rows. Within a group they are taken in the order of that hash. offset counts a sequence's tokens from 0 without gaps.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns
    hash_, group = C.free(pieces, "_h", "_group")

    def pack(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column(hash_).to_numpy(), kind="stable")))
        tokens = t.column("tokens").to_numpy().astype(np.int64)
        bins = place(tokens, t.column("loss").to_numpy().astype(np.int64), limits)
        order = np.argsort(bins, kind="stable")
        b, n = bins[order], tokens[order]
        ends = np.cumsum(n)
        first = np.append(True, b[1:] != b[:-1])
        offset = ends - n - np.repeat((ends - n)[first], np.diff(np.append(np.flatnonzero(first), len(b))))
        t = t.take(pa.array(order))
        return t.select(names).append_column("sequence_id", pa.array((t.column(group)[0].as_py() << 32) + b)).append_column("offset", pa.array(offset))

    rows = pieces.withColumn(hash_, F.xxhash64(F.lit(11), "key")).withColumn(group, F.pmod(hash_, F.lit(groups)))
    return C.wide(rows, group, groups).groupBy(group).applyInArrow(C.tidied(pack), schema)


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits()) -> DataFrame:
    """Encodes each text (null: empty), appends the end id, cuts what is longer than a sequence into whole sequences and a rest, and
    packs the pieces: doc_id, start, tokens, loss, doc_tokens, sequence_id, offset and ids (little-endian, 4 bytes each).

    All tokens bear loss. Repeated rows are packed like others; an empty table gives no rows; columns other than doc_id and text are left out.
    """
    size = min(limits.tokens, limits.loss)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, z = C.encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        for b in C.slabs(batches, rows=C.TOKEN_ROWS, size=C.TOKEN_BYTES):
            offsets, ids = code.encode(b.column("text"))
            n = np.diff(offsets)
            m = -(-n // size)
            doc = np.repeat(np.arange(len(n)), m)
            start = C.ranges(np.zeros(len(m), np.int64), m) * size
            tokens = np.minimum(size, n[doc] - start)
            at = offsets[doc] + start
            ids_ = b.column("doc_id")
            who = C.mix(pc.fill_null(ids_, -1).to_numpy().view(np.uint64), b.column("h").to_numpy().view(np.uint64) ^ ids_.is_null().to_numpy(zero_copy_only=False))
            key = C.mix(who[doc], start.astype(np.uint64))  # equal pieces are alike, so it does not matter which comes first
            for k in range(0, len(doc), 2000):
                s = slice(k, k + 2000)
                blobs = [z.compress(pack_ids(ids[x : x + y])) for x, y in zip(at[s].tolist(), tokens[s].tolist(), strict=True)]
                yield pa.record_batch({
                    "doc_id": b.column("doc_id").take(pa.array(doc[s])), "start": pa.array(start[s]), "tokens": pa.array(tokens[s]), "loss": pa.array(tokens[s]), "doc_tokens": pa.array(n[doc[s]]),
                    "ids": pa.array(blobs, pa.binary()), "key": pa.array(key[s].view(np.int64)),
                })

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = max(1, -(-C.text_bytes(docs) // GROUP_BYTES))
    pieces = docs.withColumn("h", C.text_hash()).mapInArrow(C.lean(cut), "doc_id long, start long, tokens long, loss long, doc_tokens long, ids binary, key long")

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in C.slabs(batches, "ids", 2000, 1 << 20):
            cols = {c: b.column(c) for c in b.schema.names if c not in ("ids", "key")}
            yield pa.record_batch(cols | {"ids": pa.array([unpack_ids(z.decompress(x)).tobytes() for x in b.column("ids").to_pylist()], pa.binary())})

    return pack_examples(pieces, limits, groups).mapInArrow(C.lean(unzip), "doc_id long, start long, tokens long, loss long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(packed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each sequence: its ids, segments in order, and the length to pad to (its own if that is a power of two)."""
    seg = F.struct("offset", "doc_id", "start", "tokens", "ids")
    s = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(seg)).alias("s"), F.sum("tokens").alias("length"))  # limits.segments in a list at most
    return s.select("sequence_id", "length", F.when(F.col("length").bitwiseAND(F.col("length") - 1) == 0, F.col("length")).otherwise(limits.tokens).alias("padded"), F.aggregate("s.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"), F.transform("s", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["tokens"].alias("length"))).alias("segments"))


def pack_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack_documents(docs, tokenizer).select("doc_id", "start", F.col("tokens").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
