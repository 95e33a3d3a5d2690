"""I-Match fingerprints: hashes of a text's distinct mid-frequency terms under randomised subsets of the lexicon."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import common as C

#: Shares of the documents that hold a term of the lexicon: the band of inverse document frequency. The lexicon has at most
#: (mean distinct terms of a document) / LEAST terms, and those of a few groups of copies, which bounds what is broadcast.
LEAST, MOST = 0.0005, 0.1
#: A term is in subset k with probability RATES[k % 8]: small ones survive large edits of long texts, large ones tell short texts apart.
SUBSETS = 32
RATES = (0.5, 0.25, 0.12, 0.06, 0.03, 0.015, 0.0075, 0.004)
#: Distinct terms a Python worker gathers before it passes them on. Documents are read in ranges of about RANGE_BYTES, of which
#: there are from LEAST_RANGES to MOST_RANGES.
HELD = 1 << 20
#: A text's group of near copies is told by any of so many sketches, of so many least hashes each: texts that share a
#: fraction x of their terms agree in one with x ** LEAST_HASHES.
SKETCHES, LEAST_HASHES = 4, 4
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 64 << 20, 256, 20_000
EMPTY = "-" * 8


def subset_masks(h: np.ndarray) -> np.ndarray:
    """Bit k of a term's mask: whether subset k holds it, by a hash of term and k."""
    out = np.zeros(len(h), np.uint64)
    for k in range(SUBSETS):
        x = C.mix(h, np.full(len(h), k + 1, np.uint64)) >> np.uint64(32)
        out |= (x < int(RATES[k % len(RATES)] * 2**32)).astype(np.uint64) << np.uint64(k)
    return out


class Lexicon:
    def __init__(self, terms: np.ndarray) -> None:
        self.terms = np.sort(terms)
        self.masks = subset_masks(self.terms)

    def fingerprints(self, words: C.Words) -> list[str]:
        """SUBSETS hashes of eight hex digits (dashes where no term is in the subset) and one of all distinct terms of the text.
        The subsets of a text without terms of the lexicon are of all its terms."""
        h = words.hashes()
        if len(self.terms) and len(h):
            k = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            mask = np.where(self.terms[k] == h, self.masks[k], np.uint64(0))
        else:
            mask = np.zeros(len(h), np.uint64)
        out = []
        for i in range(len(words)):
            codes = words.of(i)
            x, first = np.unique(h[codes], return_index=True)  # distinct terms, sorted
            m = mask[codes[first]]
            live = m > 0
            y, m = (x[live], m[live]) if live.any() else (x, subset_masks(x))
            digests = []
            for k in range(SUBSETS):
                own = y[(m >> np.uint64(k)) & np.uint64(1) > 0]
                digests.append(xxhash.xxh32_hexdigest(own.tobytes(), k) if len(own) else EMPTY)
            digests.append(xxhash.xxh32_hexdigest(x.tobytes(), SUBSETS))
            out.append("".join(digests))
        return out


def likeness(a: str, b: str) -> float:
    """1 if all distinct terms agree; else the largest share of equal hashes among the subsets of one rate, of those that hold a
    term of either text (two subsets at least): the rate that suits the texts' length tells most."""
    if a == b:
        return 1.0
    same, some = [0] * len(RATES), [0] * len(RATES)
    for k in range(SUBSETS):
        x, y = a[8 * k : 8 * k + 8], b[8 * k : 8 * k + 8]
        if x != EMPTY or y != EMPTY:
            some[k % len(RATES)] += 1
            same[k % len(RATES)] += x == y
    return max((x / y for x, y in zip(same, some, strict=True) if y > 1), default=0.0)


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Hashes of the terms whose document frequency lies in the band.

    It is counted over all documents but those of groups of copies and near copies with over half of ``most`` of the rows,
    told by sketches of their terms: a group's own terms, which about half of it hold, are not rare, whatever the others hold,
    and not frequent for its size.
    """
    docs, total = docs.select("text"), docs.count()

    def sketches(w: C.Words) -> np.ndarray:
        """SKETCHES numbers for each text that has terms."""
        h, at, out = w.hashes(), w.offsets[:-1][w.counts > 0], []
        for k in range(SKETCHES):
            x = np.full(len(at), k, np.uint64)
            for j in range(LEAST_HASHES):
                x = C.mix(x, np.minimum.reduceat(C.mix(h, np.full(len(h), SUBSETS + 1 + k * LEAST_HASHES + j, np.uint64))[w.codes], at))
            out.append(x)
        return np.stack(out)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slabs(batches):
            w = C.Words(b.column("text"), lower=True)
            if len(w.codes):
                u, n = np.unique(sketches(w), return_counts=True)
                yield pa.record_batch({"s": pa.array(u.view(np.int64)), "n": pa.array(n)})

    groups = docs.mapInArrow(C.lean(sketch), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > max(1, most / 2 * total)).toArrow()  # SKETCHES * 2 / most rows at most
    hot, held_by = groups.column("s").to_numpy().view(np.uint64), groups.column("n").to_numpy()
    of = np.argsort(hot)
    hot, held_by = hot[of], held_by[of]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, grouped = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            u, inv = np.unique(np.concatenate([x for x, _, _ in held]), return_inverse=True)
            n = np.bincount(inv, np.concatenate([y for _, y, _ in held]), len(u)).astype(np.int64)
            share = np.bincount(inv, np.concatenate([z for _, _, z in held]), len(u))
            for at in range(0, len(u), 1 << 16):
                yield pa.record_batch({"h": pa.array(u[at : at + (1 << 16)].view(np.int64)), "n": pa.array(n[at : at + (1 << 16)]), "share": pa.array(share[at : at + (1 << 16)])})

        for b in C.slabs(batches):
            w = C.Words(b.column("text"), lower=True)
            if not len(w.codes):
                continue
            owner = np.repeat(np.arange(len(w)), w.counts)
            who, once = np.divmod(np.unique(owner * len(w.words) + w.codes), len(w.words))
            part = np.zeros(len(w))  # of its group, if that is hot
            if len(hot):
                own = sketches(w)
                k = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                part[w.counts > 0] = np.where(hot[k] == own, 1 / held_by[k], 0.0).max(axis=0)
                grouped += int((part > 0).sum())
            held.append((w.hashes(), np.bincount(once[part[who] == 0], minlength=len(w.words)), np.bincount(once, part[who], len(w.words))))
            size += len(w.words)
            if size > HELD:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()
        yield pa.record_batch({"h": pa.nulls(1, pa.int64()), "n": pa.array([grouped]), "share": pa.array([0.0])})  # texts of hot groups

    df = C.materialize(docs.mapInArrow(C.lean(count), "h long, n long, share double").groupBy("h").agg(F.sum("n").alias("n"), F.sum("share").alias("share")), "terms")
    rest = total - (df.where("h is null").agg(F.sum("n")).first()[0] or 0)
    band = df.where(F.col("h").isNotNull() & ((F.col("n") >= max(2, least * rest)) | (F.col("share") >= 0.5)) & (F.col("n") <= max(2, most * rest)))
    return band.select("h").toArrow().column("h").to_numpy().view(np.uint64)


def fingerprint_pairs(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """For each document its fingerprint, that of its edited text and their likeness to it, and the likeness of the next document.

    The next document has the next smaller doc_id (after the smallest comes the largest; nulls are smallest; rows of one
    identifier are ordered by a hash of their text). Ranges of identifiers are read in order, each with a copy of the first
    document of the range that follows, so only the texts move, once, compressed. Null texts are empty. A text without
    words has a fingerprint of no terms, which is like any other such. A single document is its own next one. Columns other
    than doc_id and text are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lex = spark.sparkContext.broadcast(Lexicon(lexicon(docs, least, most)))
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = min(MOST_RANGES, max(LEAST_RANGES, C.text_bytes(docs) // RANGE_BYTES))
    cuts = docs.select(F.percentile_approx(place, F.lit([k / n for k in range(1, n)]), 100_000).alias("c")).first()[0] or []
    cuts = sorted(set(cuts))
    tie = F.xxhash64("text")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, bounds = zstandard.ZstdCompressor(level=3), np.array(cuts, np.int64)
        for b in C.slabs(batches):
            ids = b.column("place").to_numpy()
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "place": b.column("place"), "tie": b.column("tie"), "part": pa.array(np.searchsorted(bounds, ids, "left").astype(np.int64)),
                "zipped": pa.array([z.compress((s or "").encode()) for s in b.column("text").to_pylist()], pa.binary()), "ghost": pa.array(np.zeros(len(ids), bool)),
            })

    schema = "doc_id long, place long, tie long, part long, zipped binary, ghost boolean"

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array(cuts, np.int64)
        for b in batches:
            ids = b.column("place").to_numpy()
            yield pa.record_batch({"place": b.column("place"), "tie": b.column("tie"), "part": pa.array(np.searchsorted(bounds, ids, "left").astype(np.int64))})

    parts = docs.select(place.alias("place"), tie.alias("tie")).mapInArrow(C.lean(ranged), "place long, tie long, part long")
    firsts = parts.groupBy("part").agg(F.max(F.struct("place", "tie")).alias("first")).orderBy("part").collect()  # MOST_RANGES rows at most
    # the first document of a range also ends the nonempty range of larger identifiers that comes before it
    before = {r["part"]: (firsts[k + 1]["part"] if k + 1 < len(firsts) else firsts[0]["part"]) for k, r in enumerate(firsts)}
    goes_to = [(r["first"]["place"], r["first"]["tie"], before[r["part"]]) for r in firsts]
    rows = docs.withColumn("place", place).withColumn("tie", tie)
    whole = rows.mapInArrow(C.lean(shrink), schema)
    ghosts = spark.createDataFrame(goes_to or [(0, 0, 0)], "place long, tie long, to long").limit(len(goes_to))
    ghosts = whole.join(F.broadcast(ghosts), ["place", "tie"]).dropDuplicates(["place", "tie"]).select("doc_id", "place", "tie", F.col("to").alias("part"), "zipped", F.lit(True).alias("ghost"))
    tables = whole.union(ghosts)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order: for each but a range's ghost, its text edited with that of the row after it."""
        unzip = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # the last row waits for the next one
        for b in C.slabs(batches, "zipped", 500, 1 << 20):
            got = [(d, p, g, unzip.decompress(x).decode()) for d, p, g, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "ghost", "zipped")), strict=True)]
            rows_ = held + got
            yield from work(rows_)
            held = rows_[-1:]

    def work(rows_: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [(a, b) for a, b in zip(rows_, rows_[1:], strict=False) if not a[2]]
        if not pairs:
            return
        texts = [r[3] for r in rows_]
        own = dict(zip(map(id, rows_), lex.value.fingerprints(C.Words(pa.array(texts, pa.string()), lower=True)), strict=True))
        edited = [a[3][: len(a[3]) - len(a[3]) // 3] + b[3][: len(a[3]) // 3] for a, b in pairs]
        marks = lex.value.fingerprints(C.Words(pa.array(edited, pa.string()), lower=True))
        yield pa.record_batch({
            "doc_id": pa.array([a[0] for a, _ in pairs], pa.int64()), "n_chars": pa.array([len(a[3]) for a, _ in pairs], pa.int64()), "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            "fingerprint": [own[id(a)] for a, _ in pairs], "edited_fingerprint": marks,
            "near_edited": [likeness(own[id(a)], m) for (a, _), m in zip(pairs, marks, strict=True)], "near_next": [likeness(own[id(a)], own[id(b)]) for a, b in pairs],
        })

    order = [F.col("part"), F.col("ghost"), F.col("place").desc(), F.col("tie").desc()]
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return tables.repartition(tasks, "part").sortWithinPartitions(*order).mapInArrow(C.lean(walk), out)
