"""Sorted-string-table shards of token ids: prefix-compressed blocks, sparse block index, Bloom filter and footer.

File layout, all numbers little-endian:

* blocks, each zstd-compressed: entries (shared, unshared, value length as varints; the key's last ``unshared`` bytes; value)
* index: for each block its last key (length byte, bytes), offset (8 bytes) and length (4 bytes)
* Bloom filter over all keys
* footer of 64 bytes: offsets and lengths of index and filter, number of probes, entries, tokens, magic

A key is one byte 0 for a null identifier, or 1 and the identifier's eight bytes in an order that sorts as the numbers do.
A value is a width byte (2 or 4) and the ids in that many bytes each.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.llm import common as C

MAGIC = b"KLSSTBL1"
FOOTER = struct.Struct("<QQQQQQQ8s")
BLOCK_BYTES, SHARD_BYTES, BITS_A_KEY, PROBES = 64 << 10, 64 << 20, 10, 7
MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & C.MASK)


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def pack_ids(ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    return b"\2" + ids.astype("<u2").tobytes() if small else b"\4" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & C.MASK, h >> 64 | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class Writer:
    """Appends entries in key order to an open stream; holds one block, the index and the key hashes."""

    def __init__(self, out) -> None:
        self.out, self.at, self.index, self.keys = out, 0, [], []
        self.block, self.last, self.tokens = bytearray(), b"", 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = pack_ids(ids)
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.tokens = key, self.tokens + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.out.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> int:
        """Writes what follows the blocks; returns the file's size."""
        self.flush()
        index = b"".join(bytes([len(k)]) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        bits = max(64, -(-len(self.keys) * BITS_A_KEY // 8) * 8)
        bloom = np.zeros(bits // 8, np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + bloom.tobytes() + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), PROBES, len(self.keys), self.tokens, MAGIC))
        return self.at + len(index) + len(bloom) + FOOTER.size


class Reader:
    """Looks up or scans one shard; reads the footer, index and filter once, and then single blocks."""

    def __init__(self, file) -> None:
        self.file = file
        n = file.size()
        index_at, index_n, bloom_at, bloom_n, _, self.n_docs, self.n_tokens, magic = FOOTER.unpack(file.read_at(FOOTER.size, n - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string-table shard")
        raw, self.bloom = file.read_at(index_n, index_at), file.read_at(bloom_n, bloom_at)
        self.last, self.where, at = [], [], 0
        while at < len(raw):
            k = raw[at]
            self.last.append(raw[at + 1 : at + 1 + k])
            self.where.append(struct.unpack_from("<QI", raw, at + 1 + k))
            at += k + 13

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        at, n = self.where[block]
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(n, at))
        key, p = b"", 0
        while p < len(raw):
            three = []
            for _ in range(3):
                x = shift = 0
                while raw[p] & 128:
                    x |= (raw[p] & 127) << shift
                    shift, p = shift + 7, p + 1
                three.append(x | raw[p] << shift)
                p += 1
            key = key[: three[0]] + raw[p : p + three[1]]
            p += three[1]
            yield key, raw[p : p + three[2]]
            p += three[2]

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.where)):
            yield from self.entries(k)

    def maybe(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * len(self.bloom)))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of this identifier in the shard: none if the filter or the search finds none."""
        key, out = key_of(doc_id), []
        if not self.maybe(key):
            return out
        for k in range(bisect.bisect_left(self.last, key), len(self.last)):
            found = [v for x, v in self.entries(k) if x == key]
            out += map(unpack_ids, found)
            if self.last[k] > key or not found:
                break
        return out


def write_sstables(docs: DataFrame, tokenizer: str, where: str | None = None) -> DataFrame:
    """Encodes each text (null: empty), appends the end id, and writes shards in ascending doc_id order (null first).

    Returns the manifest, one row a shard, itself a table in the shared folder. Documents of one identifier keep the order of
    a hash of their text. Columns other than doc_id and text are left out. An empty table gives no shard. A shard is
    written under a name of its own and listed only by the attempt that succeeds, so retries leave no half shard behind.
    """
    where = where or C.scratch(docs.sparkSession, "sstable")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), C.encoder(tokenizer)
        fs, at = C.filesystem(where)
        fs.create_dir(at, recursive=True)
        out = writer = path = None
        seq = 0

        def close() -> pa.RecordBatch:
            nonlocal writer, seq
            n = writer.close()
            out.close()
            row = pa.record_batch({"shard": [(part << 24) + seq], "path": [path], "n_docs": [len(writer.keys)], "n_tokens": [writer.tokens], "n_bytes": [n]})
            writer, seq = None, seq + 1
            return row

        for b in C.slabs(batches, rows=C.TOKEN_ROWS, size=C.TOKEN_BYTES):
            offsets, ids = code.encode(b.column("text"))
            for k, doc in enumerate(b.column("doc_id").to_pylist()):
                if writer is None:
                    path = f"{at}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                    out = fs.open_output_stream(path)
                    writer = Writer(out)
                writer.add(key_of(doc), ids[offsets[k] : offsets[k + 1]])
                if writer.at >= SHARD_BYTES:
                    yield close()
        if writer is not None:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = rows.mapInArrow(C.lean(write), MANIFEST).withColumn("root", F.lit(where))
    return C.materialize(manifest, "manifest")


def read_sstables(manifest: DataFrame) -> DataFrame:
    """A row for each document in the shards: doc_id, start (tokens of all documents before it), ids (little-endian, 4 bytes each)."""
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, _ = C.filesystem(row["root"])
                with fs.open_input_file(row["path"]) as f:
                    docs, starts, values, size, base = [], [], [], 0, row["base"]
                    for key, value in Reader(f).scan():
                        ids = unpack_ids(value)
                        docs.append(id_of(key))
                        starts.append(base)
                        values.append(ids.tobytes())
                        base, size = base + len(ids), size + ids.nbytes
                        if size > 4 << 20:
                            yield pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "start": starts, "ids": values})
                            docs, starts, values, size = [], [], [], 0
                    if docs:
                        yield pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "start": starts, "ids": values})

    return C.wide(based, "shard").mapInArrow(C.lean(read), "doc_id long, start long, ids binary")


def sstable_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    back = read_sstables(write_sstables(docs, tokenizer))
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


__all__ = ["Reader", "Writer", "read_sstables", "sstable_digest", "write_sstables"]
