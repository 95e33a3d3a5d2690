"""What the operators share: shared scratch tables, word batches, text packs and tokens."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Documents handled at once in a Python worker; bounds its memory together with SLAB_BYTES.
SLAB_ROWS, SLAB_BYTES = 4000, 6 << 20
#: For tokens, which gain from large slabs: a string is encoded once in each.
TOKEN_ROWS, TOKEN_BYTES = 10_000, 8 << 20


def at_workers(spark: SparkSession) -> None:
    """Lets Python workers that see this file system import the package from where the driver did; on other clusters it is installed
    or sent with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where the setting is missing and the master is local."""
    at_workers(spark)
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"keyloom-{os.getpid()}")
    return at if "://" in at or at.startswith("file:") else "file://" + os.path.abspath(at)


#: Scratch folders that this driver has named.
made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    made.append(f"{shared_dir(spark).rstrip('/')}/keyloom/{name}-{uuid.uuid4().hex}")
    return made[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and rereads it, so a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Gives memory that a task has freed back to the system: a worker that lives on holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable) -> Callable:
    """f, for mapInArrow, tidying up as a task ends."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            gc.collect()
            tidy()

    return run


def tidied(f: Callable) -> Callable:
    """f, for applyInArrow, tidying up after each group. Spark tells by the number of arguments what a function takes."""
    many = len(inspect.signature(f).parameters)

    def after(*args):
        try:
            return f(*args)
        finally:
            tidy()

    if many == 1:
        return lambda t: after(t)
    if many == 2:
        return lambda a, b: after(a, b)
    return lambda key, a, b: after(key, a, b)


def release(spark: SparkSession) -> None:
    """Lets executors collect their garbage and so give heap and buffers back that earlier steps have left: else a heap stays as
    large as the largest step made it, beside the workers of a step that needs its memory in Python."""
    n = spark.sparkContext.defaultParallelism  # idle executors get as many tasks as they have cores
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def wide(df: DataFrame, key: str, tasks: int = 0) -> DataFrame:
    """Deals df by key over partitions that are not coalesced, as small rows may stand for much work: tasks at least."""
    sc = df.sparkSession.sparkContext
    return df.repartition(max(tasks, 4 * sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def parts(spark: SparkSession, size: int, each: int) -> int:
    """How many tasks take size bytes, each some, and no fewer than keep all cores busy."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-int(size) // each))


def text_bytes(docs: DataFrame) -> int:
    """The texts' bytes, and eight for each row: what sizes groups and buckets alike however a table is stored."""
    return docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)).first()[0] or 0


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened where columns of df have them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def prefix_sums(df: DataFrame, order: str, value: str, out: str, step: int = 4096) -> DataFrame:
    """Adds out: the sum of value over rows of smaller order (a long, unique, from 0). Two levels, so no task sorts all rows."""
    from pyspark.sql import Window as W

    df = df.withColumn("_step", F.floor(F.col(order) / step))
    tops = df.groupBy("_step").agg(F.sum(value).alias("_sum"))
    w = W.partitionBy(F.floor(F.col("_step") / step)).orderBy("_step").rowsBetween(W.unboundedPreceding, -1)
    big = tops.groupBy(F.floor(F.col("_step") / step).alias("_top")).agg(F.sum("_sum").alias("_all"))
    above = W.orderBy("_top").rowsBetween(W.unboundedPreceding, -1)  # one row for step ** 2 rows
    big = big.withColumn("_over", F.coalesce(F.sum("_all").over(above), F.lit(0))).drop("_all")
    tops = tops.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0))).withColumn("_top", F.floor(F.col("_step") / step)).join(big, "_top").select("_step", (F.col("_before") + F.col("_over")).alias("_before"))
    own = W.partitionBy("_step").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.join(tops, "_step").withColumn(out, F.coalesce(F.sum(value).over(own), F.lit(0)) + F.col("_before")).drop("_step", "_before")


# -- words -------------------------------------------------------------------


def slabs(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = SLAB_ROWS, size: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into pieces of few documents and few bytes (one document at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        n = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(n[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(n, before + size, "right"))))
            yield b.slice(at, to - at)
            at = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of some texts: codes into a dictionary, and where each text's words begin."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if lower:  # A-Z only; ascii_lower leaves other code points alone
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        self.words: list[bytes] = [x.encode() for x in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if b"" in self.words:  # white space at either end makes empty strings
            keep = codes != self.words.index(b"")
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            codes = codes[keep]
        self.codes, self.offsets = codes, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.offsets[i] : self.offsets[i + 1]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each dictionary word."""
        h = xxhash.xxh64_intdigest
        return np.fromiter((h(w) for w in self.words), np.uint64, len(self.words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(29))) * M1 + b * M2
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted 64-bit hashes; a text of fewer words has its whole sequence as one, one without words has none."""
    if not len(words.codes):
        return [np.zeros(0, np.uint64) for _ in range(len(words))]
    w = words.hashes()[words.codes]
    roll = w[: max(0, len(w) - n + 1)].copy()
    for k in range(1, n):
        roll = mix(roll, w[k : k + len(roll)])
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(roll[a : b - n + 1]))
        elif b > a:
            h = w[a : a + 1]
            for k in range(a + 1, b):
                h = mix(h, w[k : k + 1])
            out.append(mix(h, np.array([b - a], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# -- sorted keys between tasks ------------------------------------------------


def cut_ranges(u: np.ndarray, width: float, many: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of each range of width that sorted hashes fall in; a hash's range depends on its leading 32 bits alone."""
    part = np.minimum(((u >> np.uint64(32)).astype(np.float64) * (2.0**32 / width)).astype(np.int64), many - 1)
    s = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(u) else np.zeros(0, np.int64)
    yield from zip(part[s].tolist(), s.tolist(), np.append(s[1:], len(u)).tolist(), strict=True)


def pack_keys(u: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane, so that their leading zeros take no room, and other arrays."""
    planes = np.diff(u, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join(len(x).to_bytes(8, "little") for x in (u, *more)) + planes + b"".join(x.tobytes() for x in more))


def unpack_keys(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, *sizes = (int.from_bytes(raw[8 * k : 8 * k + 8], "little") for k in range(1 + len(types)))
    at = 8 * (1 + len(types))
    out = [np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)]
    at += 8 * n
    for t, k in zip(types, sizes, strict=True):
        out.append(np.frombuffer(raw, t, k, at))
        at += k * np.dtype(t).itemsize
    return out


# -- tokens ------------------------------------------------------------------

END = 2
#: Byte-level BPE names a byte by a printable character: itself where it is one, else the next from U+0100.
_OTHER = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_LEVEL = {b: 0x100 + k for k, b in enumerate(_OTHER)}
_POINTS = np.array([BYTE_LEVEL.get(b, b) if b != 0x20 else b for b in range(256)], "<u4")  # for strings that blanks separate


class Encoder:
    """Encodes texts as Tokenizer.encode(text, add_special_tokens=False) does, each distinct white-space-separated string of them once.

    Exact where the tokenizer's normalizer and pre-tokenizer never look across white space and the last token of a run of letters
    can be told, which ``local`` checks on the tokenizer's own description; another tokenizer encodes whole texts.
    """

    #: Strings that one call encodes: few calls, and little memory held by the tokenizer's own results.
    JOINED = 1000
    #: Letters up to U+00FF and at most a mark after them; normalization only lowers them, splitting only parts the mark.
    PLAIN, MARKS = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+[.,;:!?]?$", ".,;:!?"

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        d = json.loads(self.tokenizer.to_str())
        self.local = self._local(d)
        if self.local:
            vocab, end = d["model"]["vocab"], d["model"]["end_of_word_suffix"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(end)]] = True
            self.marks = np.zeros(128, np.uint32)
            self.marks[[ord(c) for c in self.MARKS]] = [vocab[c + end] for c in self.MARKS]
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = CharDelimiterSplit(" ")

    @staticmethod
    def _local(d: dict) -> bool:
        """NFC, folded white space and lower case; white space removed before a byte-level BPE that knows all bytes and marks a word's last token."""
        norm = d.get("normalizer") or {}
        kinds = [x["type"] for x in norm.get("normalizers", [norm] if norm else [])]
        pre = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in pre] == ["Split", "ByteLevel"]
            and pre[0]["behavior"] == "Removed"
            and pre[0]["invert"]
            and "^\\s" in pre[0]["pattern"].get("Regex", "")
            and not pre[1]["add_prefix_space"]
            and d["model"]["type"] == "BPE"
            and "<" in (d["model"].get("end_of_word_suffix") or "")  # no letter's token holds it but the last
            and all(c + e in d["model"]["vocab"] for c in (chr(BYTE_LEVEL.get(b, b)) for b in range(256)) for e in ("", d["model"]["end_of_word_suffix"]))
            and not any(x["lstrip"] or x["rstrip"] or " " in x["content"] for x in d["added_tokens"])
        )

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of runs of lower-case letters up to U+00FF, which normalization and splitting leave as they are."""
        got = [np.zeros(0, np.uint32)]
        at = pa.array(np.append(np.arange(0, len(runs), self.JOINED, np.int32), np.int32(len(runs))))
        for joined in pc.binary_join(pa.ListArray.from_arrays(at, runs), " ").cast(pa.binary()):
            points = _POINTS[np.frombuffer(joined.as_py(), np.uint8)].tobytes().decode("utf-32-le")
            got += [np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast([points], add_special_tokens=False)]
        ids = np.concatenate(got)
        sizes = np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)
        if len(sizes) != len(runs):
            raise ValueError("the tokenizer's last tokens don't tell runs of letters apart")
        return sizes, ids

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.zeros(0, np.uint32)]
        for k in range(0, len(words), self.JOINED):
            rows += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words[k : k + self.JOINED], add_special_tokens=False)]
        return np.fromiter(map(len, rows[1:]), np.int64, len(words)), np.concatenate(rows)

    def _strings(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, ids): the ids of string i are ids[starts[i]:starts[i] + sizes[i]]."""
        plain = pc.match_substring_regex(words, self.PLAIN)
        low = pc.utf8_lower(words.filter(plain))
        runs = pc.utf8_rtrim(low, self.MARKS)
        marked = pc.not_equal(pc.binary_length(low), pc.binary_length(runs)).to_numpy(zero_copy_only=False)
        kinds = runs.dictionary_encode()
        n, ids = self._runs(kinds.dictionary)
        kind = kinds.indices.to_numpy(zero_copy_only=False)
        own = n[kind]
        mark = np.frombuffer("".join(pc.utf8_slice_codeunits(low.filter(pa.array(marked)), -1).to_pylist()).encode(), np.uint8)
        ids = np.insert(ids[ranges((np.cumsum(n) - n)[kind], own)], np.cumsum(own)[marked], self.marks[mark])
        m, more = self._others(words.filter(pc.invert(plain)).to_pylist())
        is_plain = plain.to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)])
        n = np.concatenate([own + marked, m])
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[order], sizes[order] = np.cumsum(n) - n, n
        return starts, sizes, np.concatenate([ids, more])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i, with the end id after them, are ids[offsets[i]:offsets[i + 1]]."""
        if not self.local:
            rows = [np.array(e.ids + [END], np.uint32) for e in self.tokenizer.encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64), np.concatenate([*rows, np.zeros(0, np.uint32)])
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = lists.flatten().dictionary_encode()  # white space at either end makes empty strings, which have no ids
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        starts, sizes, flat = self._strings(coded.dictionary)
        flat = np.append(flat, np.uint32(END))
        starts, sizes = np.append(starts, len(flat) - 1).astype(np.int32), np.append(sizes, 1).astype(np.int32)
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), at[1:], len(starts) - 1)  # the end id after each text
        bounds = at + np.arange(len(at))
        n = sizes[codes]
        ends = np.cumsum(n, dtype=np.int64)
        shift = (starts[codes] - (ends - n)).astype(np.int32)
        ids = flat[np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32) + np.repeat(shift, n)]
        return np.concatenate([[0], ends])[bounds], ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, as reading a tokenizer takes a while."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# -- packs: texts kept once in the shared folder -----------------------------

PACK_BYTES = 2 << 20
META = "doc_id long, uid long, pack string, row int, n_bytes long, h1 long, h2 long"


def write_packs(docs: DataFrame, where: str) -> DataFrame:
    """Stores every text in compressed files of about PACK_BYTES under where, and returns a materialized row (META) for each document.

    h1 is what text_hash() gives. uid is unique and orders rows of equal doc_id. A retried task writes new files under new names; the rows of the
    attempt that counts name its files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, at = filesystem(where)
        fs.create_dir(at, recursive=True)
        held: list[pa.RecordBatch] = []
        size = seen = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seen
            name = f"{part:06d}-{uuid.uuid4().hex}.arrow"
            texts = pa.chunked_array([b.column("text") for b in held]).combine_chunks().cast(pa.string())
            ids = pa.chunked_array([b.column("doc_id") for b in held]).combine_chunks()
            texts = pc.fill_null(texts, "")
            texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
            table = pa.table({"text": texts})
            with fs.open_output_stream(f"{at}/{name}") as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table, max_chunksize=64)
            raw = [x.encode() for x in texts.to_pylist()]
            n = len(raw)
            meta = pa.record_batch({
                "doc_id": ids.cast(pa.int64()), "uid": pa.array((part << 36) + np.arange(seen, seen + n)), "pack": pa.array([name] * n), "row": pa.array(np.arange(n, dtype=np.int32)),
                "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "h1": pa.array(np.array([xxhash.xxh64_intdigest(x, 42) for x in raw], np.uint64).view(np.int64)), "h2": pa.array(np.array([xxhash.xxh3_64_intdigest(x, 7) for x in raw], np.uint64).view(np.int64)),
            })
            held, size, seen = [], 0, seen + n
            return meta

        for b in slabs(batches):
            held.append(b)
            size += b.column("text").nbytes
            if size >= PACK_BYTES:
                yield flush()
        if held:
            yield flush()

    return materialize(docs.select("doc_id", "text").mapInArrow(lean(write), META), "meta")


def read_pack(where: str, name: str, rows: np.ndarray | None = None) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of each block of 64 texts that holds one of rows (of all, if none are given)."""
    fs, at = filesystem(where)
    with fs.open_input_file(f"{at}/{name}") as f:
        file = pa.ipc.open_file(f)
        for k in range(file.num_record_batches) if rows is None else np.unique(np.asarray(rows) // 64).tolist():
            yield 64 * k, file.get_batch(k).column("text")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def row_key() -> list[Column]:
    """What tells rows apart: identifier (null: the smallest) and text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_k"), text_hash().alias("_h")]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node of edges (a, b), component its least reachable node: alternating large-star and
    small-star steps, each written to the shared folder, until only stars are left."""
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        if e.groupBy("a").count().where("count > 1").isEmpty() and e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():  # only stars
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_m.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = materialize(small, name)
