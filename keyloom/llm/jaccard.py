"""Self-join of documents on the Jaccard similarity of their word shingles, with skipping by set relations.

Shingles are ordered by the number of distinct sets that hold them, counted over the whole corpus. Those of one set come first and
are never posted, so a set with more of them than its prefix is long has no postings at all. Index level: each set's rarest
shingles (its prefix) are posted with the set's size and their position; a list is sorted by size and cut in blocks,
and a block whose sizes or positions rule out a link is skipped whole; a heavy list is dealt as pairs of its
parts; bit maps of whole sets rule out most pairs that are left. Answer level: a set is compared with one highly similar set of its lists first. From then on the members of a
group stand behind their centre: since 1 - Jaccard is a metric, what the centre's computed distance to another centre rules out is
ruled out for all members; for the rest, a member's overlap with a set is derived from its centre's overlap with it and the
few shingles that tell the member from the centre. Documents of equal sets are one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm import common as C
from keyloom.llm.suffix import member

#: Bytes of shingles that a task gathers before it sends them on, and in a range of hashes; both only set the number of tasks.
CHUNK_BYTES, RANGE_BYTES = 32 << 20, 16 << 20
#: Sets of a list skipped or enumerated together; sets in a part of a heavy list; pairs enumerated at once.
BLOCK, HEAVY, PAIRS = 32, 1024, 1 << 17
#: 64-bit words of a set's bit map.
WORDS = 16


def pack_sets(where: str, pack: str, rows: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of the given rows of a pack."""
    rows = np.unique(rows)
    held: list[pa.Array] = []
    ids: list[int] = []

    def out() -> Iterator[tuple[int, np.ndarray]]:
        yield from zip(ids, C.shingle_sets(C.Words(pa.chunked_array(held).combine_chunks(), lower=True), n), strict=True)

    size = 0
    for first, texts in C.read_pack(where, pack, rows):
        own = rows[(rows >= first) & (rows < first + len(texts))]
        held.append(texts.take(pa.array(own - first)))
        ids += own.tolist()
        size += held[-1].nbytes
        if size > 2 << 20:
            yield from out()
            held, ids, size = [], [], 0
    if ids:
        yield from out()


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - -(-num * n // den) + 1


def need(n1, n2, num: int, den: int):
    """The smallest intersection of linked sets of these sizes; for numbers, arrays or columns."""
    x = num * (n1 + n2)
    return F.ceil(x / (num + den)) if isinstance(x, Column) else -(-x // (num + den))


def may_link(n1: Column, n2: Column, p1: Column, p2: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes that share a shingle at these positions can link, if they share all before it that they can: the size
    and position filters."""
    return (F.least(n1, n2) * den >= num * F.greatest(n1, n2)) & (F.least(p1, p2) + F.least(n1 - p1, n2 - p2) >= need(n1, n2, num, den))


def shared_least(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column, num: int, den: int) -> Column:
    """The fewest shingles that the prefixes of linked sets of sizes in these ranges share: of the intersection, what lies
    past one of the prefixes is at most the rest of that set."""
    rest = F.ceil(num * F.greatest(hi_a, hi_b) / den) - 1
    return F.greatest(need(lo_a, lo_b, num, den) - rest, F.lit(1))


def bit_map(s: np.ndarray) -> bytes:
    """For each bit whether an odd number of a set's shingles falls on it. Bits in which two maps differ are no more than shingles that
    only one of the sets holds."""
    at = np.bincount((s >> np.uint64(7)).astype(np.int64) & (64 * WORDS - 1), minlength=64 * WORDS)
    return np.packbits(at & 1).tobytes()


def counted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct pairs (the first two columns) with what belongs to them, and how often each came."""
    order = np.lexsort((columns[1], columns[0]))
    a, b = columns[0][order], columns[1][order]
    s = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    return [c[order][s] for c in columns], np.diff(np.append(s, len(a)))


BLOBS = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("blob", pa.binary())])
PAIR = "a long, b long, lo_a long, hi_a long, lo_b long, hi_b long, c long"


def pair_table(columns: list[np.ndarray], c: np.ndarray) -> pa.Table:
    names = ("a", "b", "lo_a", "hi_a", "lo_b", "hi_b")
    return pa.table({**{k: pa.array(v.astype(np.int64)) for k, v in zip(names, columns, strict=True)}, "c": pa.array(c.astype(np.int64))})


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, uid (unique), text_hash, n_shingles, component_id and is_first (one of each component) of each document.

    Sets link if den * |intersection| >= num * |union|; component_id is the smallest doc_id that links lead to. Words are
    maximal runs of other than ASCII white space, A-Z lower-cased; fewer words than n make one shingle; a text
    without words or null has the empty set and links with nothing, so its component is its own doc_id. Null identifiers come before others,
    so a component that holds one has a null component_id. Columns other than doc_id and text are left out.
    """
    spark = docs.sparkSession
    where = C.scratch(spark, "packs")
    meta = C.write_packs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), where)

    def sign(t: pa.Table) -> pa.Table:
        """Sizes and 128-bit signatures of a pack's sets."""
        pack, rows = t.column("pack")[0].as_py(), t.column("row").to_numpy()
        sizes, s1, s2 = (np.zeros(int(rows.max()) + 1, np.int64) for _ in range(3))
        for row, s in pack_sets(where, pack, rows, n):
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            sizes[row], s1[row], s2[row] = len(s), (d >> 64) - (1 << 63), (d & C.MASK) - (1 << 63)
        return pa.table({"doc_id": t.column("doc_id"), "uid": t.column("uid"), "pack": t.column("pack"), "row": t.column("row"), "n": pa.array(sizes[rows]), "s1": pa.array(s1[rows]), "s2": pa.array(s2[rows]), "text_hash": t.column("h1")})

    sets = C.materialize(C.wide(meta, "pack").groupBy("pack").applyInArrow(C.tidied(sign), "doc_id long, uid long, pack string, row int, n long, s1 long, s2 long, text_hash long"), "signed")
    same = ["s1", "s2", "n"]
    reps = sets.where("n > 0").groupBy(*same).agg(F.min(F.struct("uid", "pack", "row")).alias("r")).select(*same, "r.uid", "r.pack", "r.row")
    reps = C.materialize(reps, "sets")
    total = reps.agg(F.sum("n")).first()[0] or 0
    chunks, ranges_ = C.parts(spark, 8 * total, CHUNK_BYTES), C.parts(spark, 8 * total, RANGE_BYTES)
    reps = reps.withColumn("chunk", F.pmod(F.xxhash64("pack"), F.lit(chunks)))
    wide_ = 2.0**64 / ranges_

    def of_packs(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """(uid, shingles) of the sets of a chunk."""
        uid = dict(zip(zip(t.column("pack").to_pylist(), t.column("row").to_pylist(), strict=True), t.column("uid").to_pylist(), strict=True))
        by: dict[str, list[int]] = {}
        for pack, row in uid:
            by.setdefault(pack, []).append(row)
        for pack, rows in sorted(by.items()):
            for row, s in pack_sets(where, pack, np.array(rows, np.int64), n):
                yield uid[pack, row], s

    def gather(t: pa.Table) -> pa.Table:
        """Shingles of a chunk's sets, and of how many, by range of hashes."""
        held, size, out = [], 0, {"chunk": [], "part": [], "blob": []}

        def flush() -> None:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            for part, a, b in C.cut_ranges(u, wide_, ranges_):
                more = np.flatnonzero(c[a:b] > 1)
                for k, v in zip(out, (t.column("chunk")[0].as_py(), part, C.pack_keys(u[a:b], more.astype(np.uint32), c[a:b][more].astype(np.uint32))), strict=True):
                    out[k].append(v)

        for _, s in of_packs(t):
            held.append(s)
            size += s.nbytes
            if size >= CHUNK_BYTES:
                flush()
                held, size = [], 0
        if held:
            flush()
        return pa.table(out, schema=BLOBS)

    gathered = C.wide(reps, "chunk", chunks).groupBy("chunk").applyInArrow(C.tidied(gather), "chunk long, part long, blob binary")

    def frequencies(t: pa.Table) -> pa.Table:
        """For each chunk, those of its shingles in a range that several sets hold, and how many."""
        got = [C.unpack_keys(x, "<u4", "<u4") for x in t.column("blob").to_pylist()]
        every = np.sort(np.concatenate([k for k, _, _ in got]))
        several = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(k[m] for k, m, _ in got)]))
        del every
        count, own = np.zeros(len(several), np.int64), []
        for k, m, c in got:
            at = np.flatnonzero(member(k, several))
            number = np.ones(len(k), np.int64)
            number[m] = c
            i = np.searchsorted(several, k[at])
            count[i] += number[at]  # a blob's shingles are distinct
            own.append(i)
        blobs = [C.pack_keys(several[i], np.minimum(count[i], 1 << 31).astype(np.uint32)) for i in own]
        return pa.table({"chunk": t.column("chunk"), "part": t.column("part"), "blob": pa.array(blobs, pa.binary())}, schema=BLOBS)

    known_to = C.wide(gathered, "part", ranges_).groupBy("part").applyInArrow(C.tidied(frequencies), "chunk long, part long, blob binary")

    def post(key, t: pa.Table, back: pa.Table) -> pa.Table:
        """The shared part of the prefixes of a chunk's sets: shingle, uid, size, position (from 1); and the bit maps of these sets."""
        got = [C.unpack_keys(x, "<u4") for x in back.column("blob").to_pylist()]
        several, first = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in got)]), return_index=True)
        count = np.concatenate([np.zeros(0, np.uint32), *(c for _, c in got)])[first]
        del got
        out: list[list[np.ndarray]] = [[], [], [], []]
        maps: dict[int, bytes] = {}
        for uid, s in of_packs(t) if len(several) else ():
            k = np.searchsorted(several, s)
            k = k[several[np.minimum(k, len(several) - 1)] == s]
            lone, m = len(s) - len(k), int(prefix_length(np.array(len(s)), num, den))
            if lone < m:
                k = k[np.lexsort((k, count[k]))[: m - lone]]
                maps[uid] = bit_map(s)
                for x, y in zip(out, (several[k], np.full(len(k), uid), np.full(len(k), len(s)), lone + 1 + np.arange(len(k))), strict=True):
                    x.append(y)
        tok, ids, size, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        first, m = pa.table({"h": pa.array(tok.view(np.int64)), "uid": pa.array(ids), "n": pa.array(size), "pos": pa.array(pos), "bits": pa.nulls(len(tok), pa.binary())}), len(maps)
        more = pa.table({"h": pa.nulls(m, pa.int64()), "uid": pa.array(list(maps), pa.int64()), "n": pa.nulls(m, pa.int64()), "pos": pa.nulls(m, pa.int64()), "bits": pa.array(list(maps.values()), pa.binary())})
        return pa.concat_tables([first, more])

    posted = C.wide(reps.select("uid", "pack", "row", "chunk"), "chunk", chunks).groupBy("chunk").cogroup(C.wide(known_to, "chunk", chunks).groupBy("chunk")).applyInArrow(C.tidied(post), "h long, uid long, n long, pos long, bits binary")
    posted = C.materialize(posted, "postings")
    maps, posted = posted.where("bits is not null").select(F.col("uid").alias("centre"), "bits"), posted.where("h is not null").drop("bits")
    # Each list's sets with the one in whose order the shingle comes first: it has the fewest shingles of its own, as the text from
    # which others were edited has.
    lists = posted.groupBy("h").agg(F.count("*").alias("many"), F.min(F.struct("pos", "uid", "n")).alias("c")).where("many > 1").select("h", F.col("c.uid").alias("a"), F.col("c.n").alias("n_a"), F.col("c.pos").alias("pos_a"))
    shared = C.materialize(posted.join(lists, "h"), "lists")
    stars = shared.where((F.col("uid") != F.col("a")) & may_link(F.col("n"), F.col("n_a"), F.col("pos"), F.col("pos_a"), num, den))
    stars = stars.select("a", F.col("uid").alias("b"), F.col("n_a").alias("lo_a"), F.col("n_a").alias("hi_a"), F.col("n").alias("lo_b"), F.col("n").alias("hi_b"), F.lit(1).alias("c"))

    def enough(pairs: DataFrame) -> DataFrame:
        """Pairs whose prefixes share as many shingles as a link takes, over all lists."""
        sizes = ["lo_a", "hi_a", "lo_b", "hi_b"]
        p = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), *[F.first(x).alias(x) for x in sizes])
        return p.where(F.col("c") >= shared_least(*map(F.col, sizes), num, den)).select("a", "b")

    at = reps.select("uid", "pack", "row")

    def shipper(t: pa.Table) -> pa.Table:
        """The sets of some rows of a pack, once for each pack that they are sent to."""
        to: dict[int, list[str]] = {}
        uid = {}
        for a, row, pack in zip(*(t.column(c).to_pylist() for c in ("a", "row_a", "pack_b")), strict=True):
            to.setdefault(row, []).append(pack)
            uid[row] = a
        out: dict[str, list] = {"a": [], "pack_b": [], "set": []}
        for row, s in pack_sets(where, t.column("pack_a")[0].as_py(), np.array(list(to), np.int64), n):
            for pack in to[row]:
                out["a"].append(uid[row])
                out["pack_b"].append(pack)
                out["set"].append(s.tobytes())
        return pa.table(out, schema=pa.schema([("a", pa.int64()), ("pack_b", pa.string()), ("set", pa.binary())]))

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """a, b and their sets' distance, linked: a's set travels once to each pack that holds one of its partners."""
        p = pairs.join(at.select(F.col("uid").alias("a"), F.col("pack").alias("pack_a"), F.col("row").alias("row_a")), "a").join(at.select(F.col("uid").alias("b"), F.col("pack").alias("pack_b"), F.col("row").alias("row_b")), "b")
        p = C.materialize(p, f"{name}-pairs")

        shipped = C.wide(p.select("a", "pack_a", "row_a", "pack_b").distinct(), "pack_a").groupBy("pack_a").applyInArrow(C.tidied(shipper), "a long, pack_b string, set binary")

        def compare(key, t: pa.Table, sets_: pa.Table) -> pa.Table:
            index = {a: k for k, a in enumerate(sets_.column("a").to_pylist())}
            blobs = sets_.column("set")
            partners: dict[int, list[tuple[int, int]]] = {}
            for a, b, row in zip(*(t.column(c).to_pylist() for c in ("a", "b", "row_b")), strict=True):
                partners.setdefault(row, []).append((a, b))
            out: dict[str, list] = {"a": [], "b": [], "inter": [], "n_a": [], "n_b": []}
            for row, s in pack_sets(where, t.column("pack_b")[0].as_py(), np.array(list(partners), np.int64), n) if partners else ():
                for a, b in partners[row]:
                    other = np.frombuffer(blobs[index[a]].as_py(), np.uint64)
                    for c, v in zip(out, (a, b, int(member(other, s).sum()), len(other), len(s)), strict=True):
                        out[c].append(v)
            return pa.table(out, schema=pa.schema([(c, pa.int64()) for c in out]))

        done = C.wide(p, "pack_b").groupBy("pack_b").cogroup(C.wide(shipped, "pack_b").groupBy("pack_b")).applyInArrow(C.tidied(compare), "a long, b long, inter long, n_a long, n_b long")
        union = F.col("n_a") + F.col("n_b") - F.col("inter")
        return C.materialize(done.select("a", "b", (1 - F.col("inter") / union).alias("d"), (union - F.col("inter")).alias("apart"), (den * F.col("inter") >= num * union).alias("linked")), name)

    stars_ = verify(enough(stars), "stars")
    links = stars_.where("linked").select("a", "b")
    group = C.materialize(C.components(links), "groups")
    centre = stars_.where("linked").groupBy(F.col("b").alias("uid")).agg(F.min(F.struct("d", "a", "apart")).alias("c"))
    about = group.withColumnRenamed("node", "uid").join(centre, "uid", "left").join(reps.select("uid", "n"), "uid").select("uid", "n", "component", F.coalesce("c.a", "uid").alias("centre"), F.coalesce("c.d", F.lit(0.0)).alias("radius"), F.coalesce("c.apart", F.lit(0)).alias("apart"))
    about = C.materialize(about, "members")
    spread = about.groupBy("centre").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("apart").alias("far"))
    about = C.materialize(about.drop("n", "apart").join(spread, "centre"), "centres")
    known = shared.join(about, "uid", "left").select("h", "n", "pos", F.coalesce("component", "uid").alias("component"), F.coalesce("centre", "uid").alias("centre"), F.coalesce("lo", "n").alias("lo"), F.coalesce("hi", "n").alias("hi"), F.coalesce("far", F.lit(0)).alias("far"))
    # a list's members behind one centre are one entry: what they can share at most, before and after it
    entries = known.groupBy("h", "centre").agg(*[F.first(c).alias(c) for c in ("component", "lo", "hi", "far")], F.min("n").alias("least"), F.max("pos").alias("upto"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    entries = C.materialize(entries, "entries")
    several = entries.groupBy("h").agg(F.count("*").alias("many"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("h", F.ceil(F.col("many") / HEAVY).alias("cuts"))
    own = F.pmod(F.xxhash64(F.lit(5), "centre"), F.col("cuts"))
    dealt = entries.join(several, "h").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    dealt = dealt.join(maps, "centre")
    deals = C.parts(spark, 256 * entries.count(), RANGE_BYTES)
    dealt = dealt.select("h", F.xxhash64("h", "i", "j").alias("list"), (F.col("i") == F.col("j")).alias("whole"), "side", "component", "centre", "lo", "hi", "far", "least", "upto", "rest", "bits").withColumn("part", F.pmod(F.col("list"), F.lit(deals)))

    def across(t: pa.Table) -> pa.Table:
        """Pairs of centres of different groups with members in one list, and in how many: those of which any members there can link."""
        col = lambda c: t.column(c).to_numpy()
        h, lo = col("list"), col("lo")
        order = np.lexsort((col("centre"), lo, h))
        h, lo = h[order], lo[order]
        comp, ctr, hi, far, least, upto, rest, side = (col(c)[order] for c in ("component", "centre", "hi", "far", "least", "upto", "rest", "side"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, WORDS)[order]
        whole = t.column("whole").to_numpy(zero_copy_only=False)[order]
        lists_ = np.cumsum(np.append(False, h[1:] != h[:-1]))
        top = np.int64(max(int(lo.max(initial=0)), int(hi.max(initial=0)) * den // num) + 1)
        # sorted by size, an entry's partners of fitting size are the stretch that follows it
        end = np.searchsorted(lists_ * top + lo, lists_ * top + hi * den // num, "right")
        at = np.arange(len(h))
        blocks = np.arange(0, len(h), BLOCK)
        u, r, m = (f.reduceat(x, blocks) if len(h) else x for f, x in ((np.maximum, upto), (np.maximum, rest), (np.minimum, least)))
        fits = lambda a, b, c, x, y, z: np.minimum(a, x) + np.minimum(b, y) >= need(c, z, num, den)
        k = np.where(end > at + 1, (end - 1) // BLOCK - (at + 1) // BLOCK + 1, 0)
        total = np.cumsum(k * BLOCK)
        got: list[list[np.ndarray]] = []
        a = 0
        while a < len(h):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
            x = np.repeat(at[a:b], k[a:b])
            block = C.ranges((at[a:b] + 1) // BLOCK, k[a:b])
            live = fits(upto[x], rest[x], least[x], u[block], r[block], m[block])
            x, block = x[live], block[live]
            s, e = np.maximum(x + 1, block * BLOCK), np.minimum(end[x], (block + 1) * BLOCK)
            y, x = C.ranges(s, e - s), np.repeat(x, e - s)
            ok = (comp[x] != comp[y]) & (whole[x] | (side[x] != side[y])) & fits(upto[x], rest[x], least[x], upto[y], rest[y], least[y])
            x, y = x[ok], y[ok]
            # members of linked groups differ in so many shingles at most, and their centres in a few more
            apart = (hi[x] + hi[y]) * (den - num) // (den + num) + far[x] + far[y]
            ok = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= apart
            x, y = x[ok], y[ok]
            p, q = np.where(ctr[x] < ctr[y], x, y), np.where(ctr[x] < ctr[y], y, x)
            pairs_, c = counted(ctr[p], ctr[q], lo[p], hi[p], lo[q], hi[q])
            got.append([*pairs_, c])
            a = b
        columns = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 7
        return pair_table(columns[:6], columns[6])

    pairs = enough(C.wide(dealt, "part", deals).groupBy("part").applyInArrow(C.tidied(across), PAIR)).join(stars_.select("a", "b"), ["a", "b"], "left_anti")
    centres_ = verify(pairs, "between")
    group = C.materialize(C.components(links.union(centres_.where("linked").select("a", "b"))), "groups")
    # Members behind centres that don't link: only those that the triangle inequality leaves open, of groups not yet joined. The
    # members of the smaller group travel to the packs that hold members of the larger, and are compared there until one links.
    size = about.groupBy("centre").agg(F.max("radius").alias("reach"), F.count("*").alias("members"))
    open_ = centres_.union(stars_).where("not linked").select("a", "b", "d")
    for c in ("a", "b"):
        open_ = open_.join(size.select(F.col("centre").alias(c), F.col("reach").alias(f"reach_{c}"), F.col("members").alias(f"members_{c}")), c, "left").join(group.select(F.col("node").alias(c), F.col("component").alias(f"g{c}")), c, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    slack = 1 - num / den + 1e-9
    open_ = open_.where((zero("members_a") + zero("members_b") > 0) & (F.col("d") <= slack + zero("reach_a") + zero("reach_b")) & (F.coalesce("ga", "a") != F.coalesce("gb", "b")))
    swap = zero("members_b") > zero("members_a")
    open_ = open_.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("big"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("small"), "d", F.when(swap, zero("reach_b")).otherwise(zero("reach_a")).alias("reach"))
    open_ = C.materialize(open_, "open")
    if not open_.isEmpty():
        behind = about.where("uid <> centre").select("centre", "uid", "radius")
        behind = behind.union(open_.select(F.explode(F.array("big", "small")).alias("centre")).distinct().select("centre", F.col("centre").alias("uid"), F.lit(0.0).alias("radius")))
        behind = C.materialize(behind.join(at, "uid"), "behind")
        asked = open_.join(behind.select(F.col("centre").alias("small"), F.col("uid").alias("y"), F.col("radius").alias("ry"), F.col("pack").alias("pack_a"), F.col("row").alias("row_a")), "small").where(F.col("d") <= slack + F.col("reach") + F.col("ry"))
        packs = behind.join(open_.select(F.col("big").alias("centre")).distinct(), "centre", "left_semi").select(F.col("centre").alias("big"), "pack").distinct()
        asked = C.materialize(asked.join(packs, "big").select("y", "pack_a", "row_a", F.col("pack").alias("pack_b"), "big", "small", (F.col("d") - F.col("ry") - slack).alias("least")), "asked")
        middle = asked.select(F.col("big").alias("uid"), "pack_b").distinct().join(at, "uid").select(F.col("uid").alias("a"), F.col("pack").alias("pack_a"), F.col("row").alias("row_a"), "pack_b")
        sent = C.wide(asked.select(F.col("y").alias("a"), "pack_a", "row_a", "pack_b").union(middle).distinct(), "pack_a").groupBy("pack_a").applyInArrow(C.tidied(shipper), "a long, pack_b string, set binary")
        sent = asked.select("pack_b", "y", "big", "small", "least", F.lit(None).cast("binary").alias("set")).union(sent.select("pack_b", F.col("a").alias("y"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("double"), "set"))

        def answer(key, t: pa.Table, members: pa.Table) -> pa.Table:
            """Links (y, x) of the sets y that were sent and members x in this pack: of each group one for a y is enough. The overlap of x
            and y follows from that of x's centre and y, less what x lacks of the centre, plus what it has besides."""
            sets_, asks, links_ = {}, {}, []
            for y, big, small, least_, s in zip(*(t.column(c).to_pylist() for c in ("y", "big", "small", "least", "set")), strict=True):
                if s is not None:
                    sets_[y] = np.frombuffer(s, np.uint64)
                else:
                    asks.setdefault(big, []).append((y, small, least_))
            found: set[tuple[int, int]] = set()
            overlap: dict[tuple[int, int], int] = {}
            own: dict[int, list[tuple[int, int, float]]] = {}
            for row, big, uid, radius in zip(*(members.column(c).to_pylist() for c in ("row", "centre", "uid", "radius")), strict=True):
                if big in asks:
                    own.setdefault(row, []).append((big, uid, radius))
            for row, s in pack_sets(where, key[0].as_py(), np.array(list(own), np.int64), n) if own else ():
                for big, uid, radius in own[row]:
                    centre_ = sets_[big]
                    lacks, extra = centre_[~member(centre_, s)], s[~member(s, centre_)]
                    for y, small, least_ in asks[big]:
                        if radius < least_ or (y == small and uid == big) or (big, y) in found:
                            continue
                        o = sets_[y]
                        if (big, y) not in overlap:
                            overlap[big, y] = int(member(centre_, o).sum())
                        most = overlap[big, y] + len(extra)
                        if den * most < num * (len(o) + len(s) - most):
                            continue
                        inter = overlap[big, y] - int(member(lacks, o).sum()) + int(member(extra, o).sum())
                        if den * inter >= num * (len(o) + len(s) - inter):
                            found.add((big, y))
                            links_.append((y, uid))
            return pa.table({"a": pa.array([x for x, _ in links_], pa.int64()), "b": pa.array([x for _, x in links_], pa.int64())})

        inner = C.materialize(C.wide(sent, "pack_b").groupBy("pack_b").cogroup(C.wide(behind, "pack").groupBy("pack")).applyInArrow(C.tidied(answer), "a long, b long"), "inner")
        group = C.components(links.union(centres_.where("linked").select("a", "b")).union(inner))

    whole = sets.join(reps.select(*same, F.col("uid").alias("rep")), same, "left")
    whole = C.materialize(whole.join(group.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "uid", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "uid").alias("component")), "joined")
    least_id = whole.groupBy("component").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("least"), F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "uid")).alias("m"))
    return whole.join(least_id, "component").select("doc_id", "uid", "text_hash", "n_shingles", F.when(F.col("least") != -(1 << 63), F.col("least")).alias("component_id"), (F.col("m.uid") == F.col("uid")).alias("is_first"))


def jaccard_digest(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs, 4, 85, 100).select("doc_id", "n_shingles", "component_id")


