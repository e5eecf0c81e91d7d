"""Token ids as sorted-string-table shards.

A shard is one file of documents in ascending key order:

    blocks   entries with prefix-compressed keys, about BLOCK bytes each, then compressed by zstd
    index    last key, offset and length of every block (sparse: one entry for each block)
    Bloom    ten bits and seven probes for each different doc_id
    footer   fixed size: where index and Bloom filter are, counts, version and magic

A lookup asks the Bloom filter, finds the block by binary search in the index and scans that block.
A key is a doc_id in an order-preserving form, so null comes first, plus a number that tells rows of
one doc_id apart.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import Scratch, map_arrow, partitions

MAGIC, VERSION = b"SSTTOKEN", 1
#: Bytes of entries in a block before compression.
BLOCK = 1 << 16
#: Bytes of text in a shard, on average.
SHARD_BYTES = 256 << 20
#: Added to the end of each document.
END_ID = 2
_FOOTER = struct.Struct("<QQQQQQI8s")
BITS, PROBES = 10, 7


def doc_key(doc_id: int | None) -> bytes:
    """Nine bytes whose order is that of doc_ids, null first."""
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def doc_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = n = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + k * b) % bits for k in range(PROBES)]


class Writer:
    """Entries must come in ascending order of doc_id; rows of one doc_id keep the order they come in."""

    def __init__(self, out, wide: bool = False):
        import zstandard

        self.out, self.offset = out, 0
        self.dtype = "<u4" if wide else "<u2"
        self.compress = zstandard.ZstdCompressor(level=1).compress
        self.block, self.index, self.hashes = bytearray(), [], []
        self.last, self.docs, self.tokens, self.repeat = b"", 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        head = doc_key(doc_id)
        if self.last and head < self.last[:9]:
            raise ValueError("documents must come in ascending order of doc_id")
        self.repeat = self.repeat + 1 if self.last[:9] == head else 0
        key = head + struct.pack(">I", self.repeat)
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        value = np.asarray(ids).astype(self.dtype).tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.repeat:
            self.hashes.append(head)
        self.last, self.docs, self.tokens = key, self.docs + 1, self.tokens + len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def _flush(self) -> None:
        if self.block:
            data = self.compress(bytes(self.block))
            self.index.append((self.last, self.offset, len(data)))
            self._write(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index_at = self.offset
        for key, offset, length in self.index:
            self._write(_varint(len(key)) + key + _varint(offset) + _varint(length))
        bloom_at = self.offset
        bits = max(64, BITS * len(self.hashes))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.hashes:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self._write(bloom.tobytes())
        self._write(_FOOTER.pack(index_at, bloom_at, bits, len(self.index), self.docs, self.tokens, VERSION << 8 | int(self.dtype[2]), MAGIC))


class Reader:
    """Random and sequential access to one shard, given as a seekable binary file."""

    def __init__(self, file):
        import zstandard

        self.file = file
        file.seek(0, 2)
        size = file.tell()
        file.seek(size - _FOOTER.size)
        index_at, self.bloom_at, self.bits, blocks, self.docs, self.tokens, kind, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC or kind >> 8 != VERSION:
            raise ValueError("not a token shard of this version")
        self.dtype = f"<u{kind & 0xFF}"
        file.seek(index_at)
        tail = file.read(size - _FOOTER.size - index_at)
        self.bloom = tail[self.bloom_at - index_at :]
        self.keys, self.at, pos = [], [], 0
        for _ in range(blocks):
            n, pos = _read_varint(tail, pos)
            self.keys.append(tail[pos : pos + n])
            offset, pos = _read_varint(tail, pos + n)
            length, pos = _read_varint(tail, pos)
            self.at.append((offset, length))
        self.expand = zstandard.ZstdDecompressor().decompress

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, length = self.at[block]
        self.file.seek(offset)
        data, pos, key = self.expand(self.file.read(length)), 0, b""
        while pos < len(data):
            shared, pos = _read_varint(data, pos)
            fresh, pos = _read_varint(data, pos)
            size, pos = _read_varint(data, pos)
            key = key[:shared] + data[pos : pos + fresh]
            pos += fresh
            yield key, np.frombuffer(data, self.dtype, size // int(self.dtype[2]), pos)
            pos += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.at)):
            for key, ids in self._entries(block):
                yield doc_of(key), ids

    def may_have(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(doc_key(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with this doc_id."""
        head, found = doc_key(doc_id), []
        if not self.may_have(doc_id):
            return found
        for block in range(bisect.bisect_left(self.keys, head), len(self.at)):
            for key, ids in self._entries(block):
                if key[:9] == head:
                    found.append(ids)
                elif key[:9] > head:
                    return found
        return found


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(docs: DataFrame, folder: str, path: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes doc_id, text as shards of ids with END_ID; returns shard, file, docs, tokens of each, in doc_id order.

    Shards are ranges of (doc_id, hash of the text), so one doc_id of very many rows is spread too. A
    task writes under a name of its own and the manifest names the file of the attempt that counts, so
    repeated attempts do no harm. A null text is an empty one, with END_ID alone. Null doc_ids come
    first. An empty table has no shards. Other columns are ignored. Shards are as many as partitions, or
    more where these would hold over SHARD_BYTES each, so what a writer keeps for index and Bloom filter is bounded.
    """
    path = path or bpe.default_path()
    if not shards:
        # a document takes some room without a text too
        total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
        shards = max(partitions(docs.sparkSession), -(-int(total) // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        encoder, writer, out = bpe.loaded(path), None, None
        store, root = _filesystem(folder)
        wide = len(encoder.table) > 1 << 16
        name = ""
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    name = f"{root.rstrip('/')}/{uuid.uuid4().hex}.sst"
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(name)
                    writer = Writer(out, wide)
                writer.add(doc_id, np.append(encoder.encode_array(text or ""), np.uint32(END_ID)))
        if writer is not None:
            writer.close()
            out.close()
            rows = [[TaskContext.get().partitionId()], [name], [writer.docs], [writer.tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())], ["shard", "file", "docs", "tokens"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    ordered = thin.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return map_arrow(ordered, write, "shard int, file string, docs long, tokens long")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry; start counts the ids of all entries before it over all shards."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    placed = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("file", "start")
    count = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(name) as file:
                    found, at = ([], [], [], []), start
                    for doc_id, ids in Reader(file):
                        for column, value in zip(found, (doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(value)
                        at += len(ids)
                        if len(found[0]) == 10_000:
                            yield _rows(found)
                            found = ([], [], [], [])
                    if found[0]:
                        yield _rows(found)

    return map_arrow(placed.repartition(count), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(found: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-shards")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = scratch.write(write_shards(docs, scratch.path("shards")), "manifest")
    return scratch.keep(read_shards(manifest, scratch.path("shards")))
