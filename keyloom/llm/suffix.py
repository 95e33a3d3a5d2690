"""Repeated-substring removal by bucket-pointer refinement over packs of texts.

Every position of every text is a suffix. Its first bucket is its leading 8 bytes (a q-gram); the bucket of twice as many bytes
follows from the bucket identifiers of positions p and p + q, again and again, each round reusing what the last one updated
(8, 16, 32, 64 bytes, and from two overlapping 64s the full length). Identifiers are 64-bit names instead of ranks, so buckets
of different machines compare; sorting by them splits a bucket. Two windows count as one string only if their bytes agree; a
last bucket that holds several strings is split by sorting those.

A position goes on to the next refinement only if its bucket is shared: the bucket of the smallest 32-byte identifier within
its window is compared over all packs first, and only positions whose window has a shared one are refined to full length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import common as C

LENGTH, SEED = 100, 32
#: Bytes refined at once in a Python worker (arrays of eight bytes a position), and of shared identifiers in a hash range.
PIECE, RANGE_BYTES = 1 << 19, 1 << 19
#: Windows sorted at once; a range of identifiers that has more is gone through in passes, each for some of the full-length buckets.
WINDOWS = 1 << 20
#: Windows whose bytes are compared at once.
AT_ONCE = 1 << 14
#: Packs whose shared windows one task compares; more are compared in rounds.
FAN_IN = 256


def names(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of the 32 and 64 bytes at each position (positions whose bytes run past the end hold no sense)."""
    padded = np.concatenate([buf, np.zeros(72, np.uint8)])
    n = len(buf)
    q8 = np.empty(n + 64, np.uint64)
    for k in range(8):
        v = padded[k : k + (len(padded) - k) // 8 * 8].view("<u8")
        at = q8[k::8]
        at[:] = v[: len(at)]
    q16 = C.mix(q8[:-8], q8[8:])
    q32 = C.mix(q16[:-16], q16[16:])
    q64 = C.mix(q32[:-32], q32[32:])
    return q32[:n], q64[:n]


def windows(buf: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each window of length bytes: its smallest 32-byte identifier, and the identifier of all its bytes."""
    n = len(buf) - length + 1
    q32, q64 = names(buf)
    low, size, span = q32, 1, length - SEED + 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[span - size : span - size + n])
    return low, C.mix(q64[:n], q64[length - 64 : length - 64 + n])


def minima(buf: np.ndarray, row: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The 32-byte identifier at each position where it is the smallest of some window (of those with row >= 0)."""
    q32, low = names(buf)[0], windows(buf, length)[0]
    span = length - SEED + 1
    n = len(low) + span - 1
    top = np.zeros(n + span, np.uint64)  # the largest of the smallest, over the windows that hold a position
    top[span - 1 : span - 1 + len(low)] = np.where(row >= 0, low, 0)
    size = 1
    while size * 2 <= span:
        top = np.maximum(top[:-size], top[size:])
        size *= 2
    top = np.maximum(top[:n], top[span - size : span - size + n])
    return q32[:n][(top == q32[:n]) & (top > 0)]


def member(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def pieces(where: str, pack: str, rows: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row of each window or -1 where it would cross texts, its start in the text) for stretches of about PIECE bytes;
    a longer text comes in stretches that overlap by length - 1 bytes, so each window comes once."""
    wanted = set(rows.tolist())
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def out():
        buf = np.concatenate([x for _, _, x in held])
        row, at = np.full(len(buf), -1, np.int64), np.zeros(len(buf), np.int64)
        k = 0
        for r, base, x in held:
            m = len(x) - length + 1
            row[k : k + m], at[k : k + m] = r, base + np.arange(m)
            k += len(x)
        return buf, row[: len(buf) - length + 1], at[: len(buf) - length + 1]

    for first, texts in C.read_pack(where, pack, rows):
        for k, s in enumerate(texts.to_pylist()):
            if first + k not in wanted:
                continue
            raw = np.frombuffer(s.encode(), np.uint8)
            for base in range(0, max(0, len(raw) - length + 1), PIECE):
                held.append((first + k, base, raw[base : base + PIECE + length - 1]))
                size += len(held[-1][2])
                if size >= PIECE:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def _blob(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(len(a).to_bytes(8, "little") + a.tobytes() for a in arrays))


def _arrays(blob: bytes, *types: str) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for t in types:
        n = int.from_bytes(raw[at : at + 8], "little") * np.dtype(t).itemsize
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of the runs in which all keys stay the same; the last key rises by one."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    for k in keys[:-1]:
        new[1:] |= k[1:] != k[:-1]
    new[1:] |= keys[-1][1:] != keys[-1][:-1] + 1
    new[0] = True
    s = np.flatnonzero(new)
    return s, np.append(s[1:], n)


def repeated_spans(docs: DataFrame, where: str, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(meta, spans): meta has a row for each document of the packs in where, with copy_of_earlier; spans has, by pack,
    blobs of (row, first window, last window) for windows that also start earlier, unmerged."""
    if length < 64:
        raise ValueError("length must be 64 at least")
    meta = C.write_packs(docs, where)
    meta = meta.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    same = ["h1", "h2", "n_bytes"]
    first = meta.groupBy(*same).agg(F.min(F.struct("doc_id", "uid")).alias("first"))
    meta = C.materialize(meta.join(first, same).select("doc_id", "uid", "pack", "row", "n_bytes", "h1", (F.col("first.uid") != F.col("uid")).alias("copy_of_earlier")), "copies")
    texts = meta.where(f"not copy_of_earlier and n_bytes >= {length}").select("doc_id", "uid", "pack", "row", "n_bytes")
    total = texts.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, total * 16 / (length - SEED)) / RANGE_BYTES + 1))))
    shift = np.uint64(64 - bits)

    def seeds(t: pa.Table) -> pa.Table:
        """The smallest identifiers of a pack's windows, by range of hashes."""
        pack = t.column("pack")[0].as_py()
        found = [np.zeros(0, np.uint64)]
        for buf, row, _ in pieces(where, pack, t.column("row").to_numpy(), length):
            found.append(np.unique(minima(buf, row, length)))
        all_ = np.unique(np.concatenate(found))
        part = (all_ >> shift).astype(np.int64)
        k, s = np.unique(part, return_index=True)
        e = np.append(s[1:], len(all_))
        return pa.table({"part": pa.array(k), "pack": [pack] * len(k), "blob": pa.array([_blob(all_[a:b]) for a, b in zip(s, e, strict=True)], pa.binary())})

    seeded = C.materialize(C.wide(texts, "pack").groupBy("pack").applyInArrow(C.tidied(seeds), "part long, pack string, blob binary"), "seeds")

    def shared(t: pa.Table) -> pa.Table:
        """Of a range of identifiers, those in several packs, by pack."""
        packs, blobs = t.column("pack").to_pylist(), [_arrays(b, "<u8")[0] for b in t.column("blob").to_pylist()]
        u, n = np.unique(np.concatenate(blobs), return_counts=True)
        u = u[n > 1]
        kept = [x[np.isin(x, u, assume_unique=True)] for x in blobs]
        some = [k for k, x in enumerate(kept) if len(x)]
        return pa.table({"pack": [packs[k] for k in some], "blob": pa.array([_blob(kept[k]) for k in some], pa.binary())}, schema=pa.schema([("pack", pa.string()), ("blob", pa.binary())]))

    common = C.materialize(C.wide(seeded, "part").groupBy("part").applyInArrow(C.tidied(shared), "pack string, blob binary"), "shared")

    def candidates(key, t: pa.Table, own: pa.Table) -> pa.Table:
        """Windows with a shared identifier: those that also start earlier in the pack (part -1), and for the others' sake
        their bytes, by range of identifiers."""
        if not t.num_rows:
            return OUT.empty_table()
        pack, rows = t.column("pack")[0].as_py(), t.column("row").to_numpy()
        over = np.sort(np.concatenate([np.zeros(0, np.uint64), *(_arrays(b, "<u8")[0] for b in own.column("blob").to_pylist())]))
        order = np.lexsort((t.column("uid").to_numpy(), t.column("doc_id").to_numpy()))
        rank, ident = np.zeros(int(rows.max()) + 1, np.int64), np.zeros((int(rows.max()) + 1, 2), np.int64)
        rank[rows[order]] = np.arange(len(rows))
        ident[rows, 0], ident[rows, 1] = t.column("doc_id").to_numpy(), t.column("uid").to_numpy()
        found = [minima(buf, row, length) for buf, row, _ in pieces(where, pack, rows, length)]
        u, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        near = np.union1d(over, u[n > 1])  # those in several places of this pack alone are shared too
        got: list[list[np.ndarray]] = [[], [], [], []]
        held, size = [np.zeros(0, np.uint8)], 0
        by_rank = rows[order]
        for buf, row, at in pieces(where, pack, rows, length):
            low, full = windows(buf, length)
            new = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
            ok = np.flatnonzero(np.repeat(member(low[new], near), np.diff(np.append(new, len(low)))) & (row >= 0))
            if not len(ok):
                continue
            for x, y in zip(got, (low[ok], full[ok], rank[row[ok]] << 36 | at[ok], size + ok), strict=True):
                x.append(y)
            held.append(buf)
            size += len(buf)
        if not sum(map(len, got[0])):
            return OUT.empty_table()
        low, full, place, start = (np.concatenate(x) for x in got)
        got.clear()
        again = _again(C.mix(full, low), place, start, np.concatenate(held), length)
        del full, start, held
        row, at = by_rank[place >> 36].astype(np.int64), place & ((1 << 36) - 1)
        del place
        parts, packs, blobs = [-1], [pack], [_spans(row[again], at[again])]
        send = np.flatnonzero(~again & member(low, over))
        low, row, at = low[send], row[send], at[send]
        s, e = _runs(low, row, at)
        wanted = set(np.unique(row).tolist())
        raw = {first + k: x.encode() for first, block in C.read_pack(where, pack, np.array(sorted(wanted), np.int64)) for k, x in enumerate(block.to_pylist()) if first + k in wanted}
        for p, m in _by((low[s] >> shift).astype(np.int64)):
            r, a, b = row[s[m]], at[s[m]], at[e[m] - 1] + length
            text = b"".join(raw[x][y:z] for x, y, z in zip(r.tolist(), a.tolist(), b.tolist(), strict=True))
            parts.append(p)
            packs.append(pack)
            blobs.append(_blob(low[s[m]], r, ident[r, 0], ident[r, 1], a, b, np.frombuffer(text, np.uint8)))
        return pa.table({"part": pa.array(parts, pa.int64()), "pack": packs, "blob": pa.array(blobs, pa.binary())}, schema=OUT)

    cand = C.materialize(C.wide(texts, "pack").groupBy("pack").cogroup(C.wide(common, "pack").groupBy("pack")).applyInArrow(C.tidied(candidates), "part long, pack string, blob binary"), "candidates")

    def earlier(t: pa.Table) -> pa.Table:
        """Of the windows of a range of identifiers, those whose bytes also start earlier in another of these packs (part -1);
        the others go on to the next round."""
        part, packs = t.column("part")[0].as_py(), t.column("pack").to_pylist()
        blobs = [_arrays(x, "<u8", "<i8", "<i8", "<i8", "<i8", "<i8", "u1") for x in t.column("blob").to_pylist()]
        texts, text_at = np.concatenate([x[6] for x in blobs]), np.cumsum([0, *(len(x[6]) for x in blobs)])
        blobs = [[*(a.copy() for a in x[:6]), texts[p:q]] for x, p, q in zip(blobs, text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)]
        rank = _rank(*(np.concatenate([x[c] for x in blobs]) for c in (2, 3)))
        counts = [x[5] - x[4] - length + 1 for x in blobs]
        contexts, starts = (np.concatenate([[0], np.cumsum(x)]) for x in ([len(m) for m in counts], [int(m.sum()) for m in counts]))
        again = np.zeros(int(starts[-1]), bool)
        passes = -(-len(again) // WINDOWS)
        for q in range(passes):
            got: list[list[np.ndarray]] = [[], [], [], []]
            for no, (low, _, _, _, a, b, text) in enumerate(blobs):
                ends, done = np.cumsum(b - a), int(starts[no])
                for k in _slices(b - a):
                    n, m = (b - a)[k], counts[no][k]
                    first = int(ends[k.start] - n[0])
                    start = C.ranges(np.cumsum(n) - n, m)
                    bucket = C.mix(windows(text[first : ends[k.stop - 1]], length)[1][start], np.repeat(low[k], m))
                    own = np.flatnonzero(bucket % np.uint64(passes) == q) if passes > 1 else np.arange(len(bucket))
                    place = (np.repeat(rank[contexts[no] + k.start : contexts[no] + k.stop], m) << 36 | C.ranges(a[k], m))[own]
                    for x, y in zip(got, (bucket[own], place, done + own, int(text_at[no]) + first + start[own]), strict=True):
                        x.append(y)
                    done += len(bucket)
            bucket, place, index, start = (np.concatenate(x) for x in got)
            got.clear()
            again[index[_again(bucket, place, start, texts, length)]] = True
        parts, out_packs, out = [], [], []
        for no, (low, r, doc, uid, a, b, text) in enumerate(blobs):
            m, flag = counts[no], again[starts[no] : starts[no + 1]]
            context, at = np.repeat(np.arange(len(m)), m), C.ranges(a, m)
            if flag.any():
                parts.append(-1)
                out_packs.append(packs[no])
                out.append(_spans(r[context[flag]], at[flag]))
            if not last and not flag.all():
                context, at = context[~flag], at[~flag]
                s, e = _runs(context, at)
                c, f, g = context[s], at[s], at[e - 1] + length
                src = (np.cumsum(b - a) - (b - a))[c] + f - a[c]
                parts.append(part)
                out_packs.append(packs[no])
                out.append(_blob(low[c], r[c], doc[c], uid[c], f, g, text[C.ranges(src, g - f)]))
        return pa.table({"part": pa.array(parts, pa.int64()), "pack": pa.array(out_packs, pa.string()), "blob": pa.array(out, pa.binary())}, schema=OUT)

    spans, groups = cand.where("part < 0"), texts.select("pack").distinct().count()
    left = cand.where("part >= 0")
    while True:
        groups = -(-groups // FAN_IN)
        last = groups <= 1
        salted = left.withColumn("salt", F.pmod(F.xxhash64("pack"), F.lit(max(1, groups)))).withColumn("key", F.concat_ws(":", "part", "salt"))
        done = C.materialize(C.wide(salted, "key").groupBy("key").applyInArrow(C.tidied(lambda t: earlier(t)), "part long, pack string, blob binary"), "spans")
        spans, left = spans.union(done.where("part < 0")), done.where("part >= 0")
        if last:
            return meta, spans.select("pack", "blob")


def _again(bucket: np.ndarray, place: np.ndarray, start: np.ndarray, buf: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows have the bytes of an earlier one: sorting by place, then, stable, by the bucket. Each window of a bucket is
    compared with the one before it, byte by byte (they start at start in buf); a bucket of several strings is split by them."""
    order = np.argsort(place, kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    again = np.zeros(len(bucket), bool)
    view = np.lib.stride_tricks.sliding_window_view(buf, length)
    behind = np.flatnonzero(bucket[order[1:]] == bucket[order[:-1]])
    mixed = []
    for k in range(0, len(behind), AT_ONCE):
        some = behind[k : k + AT_ONCE]
        x, y = order[some], order[some + 1]
        same = (view[start[x]] == view[start[y]]).all(axis=1)
        again[y[same]] = True
        mixed.append(bucket[y[~same]])
    if not mixed or not sum(map(len, mixed)):
        return again
    of = order[member(bucket[order], np.unique(np.concatenate(mixed)))]
    _, own = np.unique(view[start[of]].view(f"V{length}").ravel(), return_inverse=True)
    by = np.lexsort((place[of], own))
    again[of] = False
    again[of[by[1:]]] = own[by[1:]] == own[by[:-1]]
    return again


def _rank(doc: np.ndarray, uid: np.ndarray) -> np.ndarray:
    order = np.lexsort((uid, doc))
    out = np.zeros(len(doc), np.int64)
    out[order[1:]] = np.cumsum((doc[order[1:]] != doc[order[:-1]]) | (uid[order[1:]] != uid[order[:-1]]))
    return out


def _by(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its indices in order) for each value of x."""
    if not len(x):
        return
    order = np.argsort(x, kind="stable")
    s = np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1]))
    for a, b in zip(s.tolist(), np.append(s[1:], len(x)).tolist(), strict=True):
        yield int(x[order[a]]), order[a:b]


def _spans(row: np.ndarray, at: np.ndarray) -> bytes:
    by = np.lexsort((at, row))
    row, at = row[by], at[by]
    s, e = _runs(row, at)
    return _blob(row[s], at[s], at[e - 1])


OUT = pa.schema([("part", pa.int64()), ("pack", pa.string()), ("blob", pa.binary())])


def _slices(n: np.ndarray) -> Iterator[slice]:
    """Stretches of rows whose sizes sum to about PIECE."""
    if not len(n):
        return
    k = np.cumsum(n) // PIECE
    s = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    for a, b in zip(s.tolist(), np.append(s[1:], len(n)).tolist(), strict=True):
        yield slice(a, b)


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each document of docs: doc_id, uid, text_hash, n_bytes, kept (the bytes that stay) and spans (start, end of removed runs).

    A byte goes if a string of length bytes that covers it also starts earlier: in a document of smaller doc_id (a null one is
    smallest; of equal ones the earlier read), or earlier in the same. Exact copies of earlier texts are told by their
    hashes alone. Within a pack only the first place of each string goes on to the comparison over packs, so a passage in a
    third of all documents is sent once a pack. Null texts are empty and keep nothing; columns other than doc_id and text are left out.
    """
    where = C.scratch(docs.sparkSession, "packs")
    meta, spans = repeated_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), where, length)

    def cut(key, t: pa.Table, found: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        pack, rows = t.column("pack")[0].as_py(), t.column("row").to_numpy()
        got = [_arrays(b, "<i8", "<i8", "<i8") for b in found.column("blob").to_pylist()]
        r, a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in got)]) for k in range(3))
        order = np.lexsort((b, a, r))
        r, a, b = r[order], a[order], b[order] + length
        bounds = np.searchsorted(r, np.arange(int(rows.max()) + 2))
        about = {x: more for x, *more in zip(rows.tolist(), *(t.column(c).to_pylist() for c in ("doc_id", "uid", "h1", "copy_of_earlier")), strict=True)}
        out: dict[str, list] = {c: [] for c in ("doc_id", "uid", "text_hash", "n_bytes", "kept", "starts", "ends")}
        for first, texts in C.read_pack(where, pack, rows):
            for k, s in enumerate(texts.to_pylist()):
                if first + k not in about:
                    continue
                raw, (doc, uid, h, copy) = s.encode(), about[first + k]
                if copy and len(raw) >= length:
                    starts, ends = [0], [len(raw)]
                else:
                    x, y = a[bounds[first + k] : bounds[first + k + 1]], b[bounds[first + k] : bounds[first + k + 1]]
                    top = np.maximum.accumulate(y) if len(y) else y
                    new = np.flatnonzero(np.append(True, x[1:] > top[:-1])) if len(x) else np.zeros(0, np.int64)
                    starts, ends = x[new].tolist(), top[np.append(new[1:] - 1, len(x) - 1)].tolist() if len(x) else []
                keep = b"".join(raw[p:q] for p, q in zip([0, *ends], [*starts, len(raw)], strict=True))
                for c, v in zip(out, (None if doc == -(1 << 63) else doc, uid, h, len(raw), keep, starts, ends), strict=True):
                    out[c].append(v)
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]))

    schema = "doc_id long, uid long, text_hash long, n_bytes long, kept binary, starts array<long>, ends array<long>"
    return C.wide(meta, "pack").groupBy("pack").cogroup(C.wide(spans, "pack").groupBy("pack")).applyInArrow(C.tidied(cut), schema)


def repeat_digest(docs: DataFrame) -> DataFrame:
    return drop_repeats(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

