"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

A count c is held as a level q, the number of entries of TABLE that do not exceed it: the n-gram is inserted with 1, 2, ... q, and
probing stops at the first number that is missing. The count read back, TABLE[q - 1], is c itself where c is small, or
a little less. The filter holds every n-gram of up to ORDER words of the training texts, those seen once too, so it grows with
them and has no size bound. It is therefore not sent whole to every worker: it is cut in regions of the n-grams' hashes, and a batch
of texts sends each region the distinct n-grams that it asks for, and gets back one byte for each. That is one way at every size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import common as C

ORDER, BASE, PROBES, BITS_A_KEY = 3, 1.2, 4, 12
#: Weight of the estimate with one word less against the counts of a context, as a number of words.
PRIOR = 5.0
END_WORD = b""
#: Words of a batch of texts (one text at least), bytes of text of a task, and bytes of asked n-grams of a region.
BATCH_WORDS, CHUNK_BYTES, REGION_BYTES = 800_000, 24 << 20, 16 << 20


#: Bits of a key: hash, order of the n-gram (one word: WORD), and whether a training text has it.
HASH, ORDERS, WORD, LEARNT = np.uint64(C.MASK - 0x7FF), np.uint64(3 << 9), np.uint64(1 << 9), np.uint64(1 << 8)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def levels() -> np.ndarray:
    """1, 2, 3, ... as long as BASE times the last is less than one more, then BASE times the last, rounded up."""
    out = [1]
    while out[-1] < 1 << 52:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * BASE))))
    return np.array(out, np.int64)


TABLE = levels()


def quantise(c: np.ndarray) -> np.ndarray:
    """Level of each count, 0 for 0."""
    return np.searchsorted(TABLE, c, "right").astype(np.uint8)


class LogFrequencyFilter:
    """One region's bits, sized by its insertions."""

    def __init__(self, h: np.ndarray, c: np.ndarray, bits_a_key: int = BITS_A_KEY) -> None:
        q = quantise(c)
        self.bits = np.zeros(max(64, bits_a_key * int(q.sum(dtype=np.int64))), bool)
        h = h[q > 0]
        q = q[q > 0]
        for level in range(1, int(q.max(initial=0)) + 1):
            h, q = h[q >= level], q[q >= level]
            for at in self._positions(h, level):
                self.bits[at] = True

    def _positions(self, h: np.ndarray, level: int) -> Iterator[np.ndarray]:
        x = C.mix(h, np.full(1, level, np.uint64))
        step = (x >> np.uint64(33)) | np.uint64(1)
        for _ in range(PROBES):
            yield (x % np.uint64(len(self.bits))).astype(np.int64)
            with np.errstate(over="ignore"):
                x = x + step

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels read back, 0 for n-grams that are not held."""
        out = np.zeros(len(h), np.uint8)
        live, level = np.arange(len(h)), 0
        while len(live) and level < len(TABLE):
            level += 1
            x = h[live]
            ok = np.ones(len(live), bool)
            for at in self._positions(x, level):
                ok &= self.bits[at]
            live = live[ok]
            out[live] = level
        return out


@dataclass
class Batch:
    """Some whole texts: their rows in the chunk, the hash of each token (the end after each text), and where each begins."""

    rows: list[int]
    h: np.ndarray
    offsets: np.ndarray

    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(place of the last word, key) of the n-grams of each order. A key has 53 bits of hash, two that tell the order and LEARNT
        left free; the lowest byte is 0, so it takes no room on its way, and the rare keys that meet err less than the filter does."""
        inside = np.arange(len(self.h)) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        out, x = [], self.h
        for n in range(1, ORDER + 1):
            at = np.flatnonzero(inside >= n - 1)
            out.append((at, x[at] & HASH | np.uint64(n << 9)))
            x = C.mix(np.concatenate([np.zeros(1, np.uint64), x[:-1]]), self.h)
        return out


def batches(where: str, t: pa.Table, most: int) -> Iterator[Batch]:
    """The texts of a chunk, always in the same order and the same batches."""
    end = np.uint64(C.xxhash.xxh64_intdigest(END_WORD))
    rows, hs, lengths, size = [], [], [], 0

    def out() -> Batch:
        return Batch(rows, np.concatenate(hs), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]))

    by: dict[str, dict[int, int]] = {}
    for k, (pack, row) in enumerate(zip(t.column("pack").to_pylist(), t.column("row").to_pylist(), strict=True)):
        by.setdefault(pack, {})[row] = k
    for pack, own in sorted(by.items()):
        place, texts = [], []
        for first, block in C.read_pack(where, pack, np.array(sorted(own), np.int64)):
            mine = [k for k in range(len(block)) if first + k in own]
            place += [own[first + k] for k in mine]
            texts.append(block.take(pa.array(mine, pa.int64())))
        for b in C.slabs(iter([pa.record_batch({"text": pa.concat_arrays(texts), "k": pa.array(place, pa.int64())})]), size=4 << 20):
            w = C.Words(b.column("text"), lower=True)
            h = w.hashes()[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
            if size and size + len(h) > most:
                yield out()
                rows, hs, lengths, size = [], [], [], 0
            rows = rows + b.column("k").to_pylist()
            hs.append(np.insert(h, w.offsets[1:], end))
            lengths.append(w.counts + 1)
            size += len(hs[-1])
    if rows:
        yield out()


BLOBS = pa.schema([("chunk", pa.int64()), ("batch", pa.int64()), ("part", pa.int64()), ("blob", pa.binary())])
ANSWERS = pa.schema([*BLOBS, ("total", pa.int64()), ("distinct", pa.int64())])


def score_lm(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each text (null: empty, only its end).

    Training texts are those whose crc32 of doc_id (null: of nothing) mod 7 is not 2; counts cover all of them. Base scores use
    exact counts. The model is an interpolation of orders 1 to ORDER: for each order the count of the n-gram, read from the filter,
    and PRIOR times the estimate of the order below, over the count of its context and PRIOR; the order below all is the
    add-one estimate. So probabilities sum to one but for what quantising leaves out; an unknown context leaves the order below as it is.
    A text is scored whole, by one task, whatever its length, and its score does not depend on the texts beside it: equal rows and equal
    texts of one kind of doc_id get equal scores. An empty table gives no rows; columns other than doc_id and text are left out.
    """
    spark = docs.sparkSession
    where = C.scratch(spark, "packs")
    meta = C.write_packs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), where).select("doc_id", "pack", "row", "n_bytes")
    size = meta.agg(F.sum("n_bytes")).first()[0] or 0
    chunks, regions = C.parts(spark, size, CHUNK_BYTES), C.parts(spark, 2 * size, REGION_BYTES)  # about two bytes of keys for each of text
    meta = meta.withColumn("chunk", F.pmod(F.xxhash64("pack"), F.lit(chunks)))
    width, bits_a_key, most = 2.0**64 / regions, BITS_A_KEY, BATCH_WORDS

    def ask(t: pa.Table) -> pa.Table:
        """The distinct n-grams of each batch of a chunk, by region, and how often training texts of the batch have them."""
        learns, out = np.array([not is_held_out(x) for x in t.column("doc_id").to_pylist()], bool), {c: [] for c in BLOBS.names}
        for no, b in enumerate(batches(where, t, most)):
            train = np.repeat(learns[b.rows], np.diff(b.offsets)).astype(np.uint64) * LEARNT
            u, c = np.unique(np.concatenate([key | train[at] for at, key in b.grams()]), return_counts=True)
            c[(u & LEARNT) == 0] = 0
            u &= ~LEARNT
            s = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            u, c = u[s], np.add.reduceat(c, s)
            for part, x, y in C.cut_ranges(u, width, regions):
                odd = np.flatnonzero(c[x:y] != 1)
                for k, v in zip(out, (t.column("chunk")[0].as_py(), no, part, C.pack_keys(u[x:y], odd.astype(np.uint32), c[x:y][odd].astype(np.uint32))), strict=True):
                    out[k].append(v)
        return pa.table(out, schema=BLOBS)

    asked = C.wide(meta, "chunk", chunks).groupBy("chunk").applyInArrow(C.tidied(ask), "chunk long, batch long, part long, blob binary")

    def answer(t: pa.Table) -> pa.Table:
        """Sums a region's counts, builds its filter, and probes it for every n-gram that was asked for. Words get their exact counts besides."""
        got = [C.unpack_keys(x, "<u4", "<u4") for x in t.column("blob").to_pylist()]
        n = np.array([len(k) for k, _, _ in got])
        h, c = np.concatenate([k for k, _, _ in got]), np.ones(int(n.sum()), np.int64)
        for (_, at, k), first in zip(got, np.cumsum(n) - n, strict=True):
            c[first + at.astype(np.int64)] = k
        del got
        by = np.argsort(h)
        s = np.flatnonzero(np.append(True, h[by][1:] != h[by][:-1]))
        u, total = h[by][s], np.add.reduceat(c[by], s)
        del c
        level = LogFrequencyFilter(u, total, bits_a_key).levels(u)
        word = (u & ORDERS) == WORD
        to = np.empty(len(h), np.int32)
        to[by] = np.repeat(np.arange(len(u), dtype=np.int32), np.diff(np.append(s, len(h))))
        del by, h
        z, blobs = zstandard.ZstdCompressor(level=1), []
        for first, many in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True):
            own = to[first : first + many]
            blobs.append(z.compress(level[own].tobytes() + total[own[word[own]]].tobytes()))
        rows = t.num_rows - 1
        sums = {"total": [int(total[word].sum())] + [0] * rows, "distinct": [int((total[word] > 0).sum())] + [0] * rows}
        return pa.table({**{x: t.column(x) for x in ("chunk", "batch", "part")}, "blob": pa.array(blobs, pa.binary()), **sums}, schema=ANSWERS)

    answers = C.materialize(C.wide(asked, "part", regions).groupBy("part").applyInArrow(C.tidied(answer), "chunk long, batch long, part long, blob binary, total long, distinct long"), "answers")
    total, distinct = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    base_all = float(total + distinct + 1)

    def score(key, t: pa.Table, back: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        blobs: dict[int, dict[int, bytes]] = {}
        for no, part, x in zip(*(back.column(c).to_pylist() for c in ("batch", "part", "blob")), strict=True):
            blobs.setdefault(no, {})[part] = x
        values = np.append(0, TABLE).astype(np.float64)
        out = {c: np.zeros(t.num_rows, kind) for c, kind in (("n_tokens", np.int64), ("n_known", np.int64), ("base_score", np.float64), ("score", np.float64))}
        for no, b in enumerate(batches(where, t, most)):
            grams = b.grams()
            u, inv = np.unique(np.concatenate([k for _, k in grams]), return_inverse=True)
            level, exact = np.zeros(len(u), np.uint8), np.zeros(len(u), np.int64)
            for part, x, y in C.cut_ranges(u, width, regions):
                raw = z.decompress(blobs[no][part])
                level[x:y] = np.frombuffer(raw, np.uint8, y - x)
                exact[x:y][(u[x:y] & ORDERS) == WORD] = np.frombuffer(raw, np.int64, -1, y - x)
            level, inv = level[inv], inv.astype(np.int64)
            n1 = len(grams[0][0])
            c1 = exact[inv[:n1]].astype(np.float64)
            del u, exact, inv
            base = p = (c1 + 1) / base_all
            before, first = None, 0  # counts of the n-grams of one order less, by the place of their last word
            for k, (at, _) in enumerate(grams):
                count = np.zeros(len(b.h))
                count[at] = values[level[first : first + len(at)]]
                first += len(at)
                if k:
                    context = before[at - 1]
                    better = p.copy()
                    better[at] = np.where(context > 0, (np.minimum(count[at], context) + PRIOR * p[at]) / (context + PRIOR), p[at])
                    p = better
                before = count
            owner = np.repeat(np.arange(len(b.rows)), np.diff(b.offsets))
            for c, x in (("n_tokens", np.diff(b.offsets)), ("n_known", np.bincount(owner, c1 > 0, len(b.rows))), ("base_score", np.bincount(owner, np.log10(base), len(b.rows))), ("score", np.bincount(owner, np.log10(p), len(b.rows)))):
                out[c][b.rows] = x
        return pa.table({"doc_id": t.column("doc_id"), **{c: pa.array(x) for c, x in out.items()}})

    scored = C.wide(meta, "chunk", chunks).groupBy("chunk").cogroup(C.wide(answers, "chunk", chunks).groupBy("chunk")).applyInArrow(C.tidied(score), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).alias("train_tokens"), "base_score", "score")
