"""Removal of byte strings that occur in an earlier document, by prefix doubling over sampled positions.

Doubling ranks positions by ever longer prefixes and lets go of those whose rank is unique. Only equal
ranks matter here, so a rank is a name, 64 bits that equal strings share, and Spark sorts names. Names
of up to ``half`` bytes come from a document's own bytes, so the first sort is at that length:

1. In each window (``width`` bytes) the anchor is the prefix of ``half`` bytes with the least name,
   leftmost of equals. Equal windows have equal anchors at equal offsets. Anchors alone are ranked, about
   one position in fourteen; an anchor of one document only is unique and takes its windows with it.
2. Windows with one anchor are a stretch, named by the ranks of its first and last window. Stretches
   are sorted by name with the least document of each. One that an earlier document has goes whole. One
   whose anchor has no other stretch has only copies of itself and stays.
3. A window's rank is the pair of ranks at its start and at the growing offset, ``width - half``. The
   windows of the stretches still open, those of each stretch's first document only, are sorted by rank.

Documents are packed into chunks of bounded size, kept as a table bucketed by chunk: no text is shuffled
again. Every sort sends arrays of names, one row for each chunk and bucket of names with each name once,
and gets one bit back for each name; a string in a third of all documents costs one name a chunk.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, map_groups, partitions
from .words import mix64

WIDTH = 50
#: Bytes of text in a chunk, but for single texts that are longer, and window starts that are named at once.
CHUNK_BYTES, SLICE = 3_000_000, 1 << 17
#: Bytes of text for each bucket of names.
NAMES_BYTES = 16_000_000
_U = np.uint64
_GAP = 0xFF  # a byte that no text in UTF-8 has
_LAST = (1 << 63) - 1
_RANK, _STRETCH, _ANCHOR, _WINDOW = 1, 2, 3, 4
_ODD = [_U(int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "little") | 1) for k in range(32)]


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))


def _stirred(x: np.ndarray) -> np.ndarray:
    y = x * _ODD[0]
    y ^= y >> _U(32)
    y *= _ODD[1]
    y ^= y >> _U(29)
    return y


def _offsets(half: int) -> list[int]:
    return [*range(0, half - 8, 8), half - 8]


def ranks(data: np.ndarray, half: int) -> np.ndarray:
    """Names of the ``half`` bytes from each place on."""
    n = len(data) - half + 1
    y = _stirred(_loads(data))
    total = np.zeros(n, _U)
    for k, o in enumerate(_offsets(half)):
        total += y[o : o + n] * _ODD[2 + k % 24]
    return mix64(total)


def ranks_at(data: np.ndarray, at: np.ndarray, half: int) -> np.ndarray:
    x = _loads(data)
    total = np.zeros(len(at), _U)
    for k, o in enumerate(_offsets(half)):
        total += _stirred(x[at + o]) * _ODD[2 + k % 24]
    return mix64(total)


def paired(one: np.ndarray, two: np.ndarray, more: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A name of 64 and one of 16 bits more for pairs of names (and a number)."""
    more = np.asarray(more).astype(_U)
    return mix64(one * _ODD[26] + two * _ODD[27] + more * _ODD[28]), (mix64(one * _ODD[29] + two * _ODD[30] + more * _ODD[31]) >> _U(48)).astype(np.uint16)


def _least_of(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    return key


def _distinct(keys: list[np.ndarray], value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each different key in ascending order, the key's number of each row, least and greatest value of each key)."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    if not len(first):
        return first, number, value[:0], value[:0]
    return order[first], number, np.minimum.reduceat(value[order], first), np.maximum.reduceat(value[order], first)


class Chunk:
    """Texts side by side with a gap after each, and what is known of their windows."""

    def __init__(self, number: int, ids: list[int | None], sizes: list[int], data: bytes, width: int, buckets: int, replies: dict[int, bytes]):
        self.number, self.ids, self.width, self.half, self.buckets, self.replies = number, ids, width, -(-width // 2), buckets, replies
        self.size = np.maximum(np.array(sizes, np.int64), 0)
        self.begin = np.cumsum(self.size + 1) - self.size - 1
        self.data = np.frombuffer(data, np.uint8)
        self.order = np.array([_LAST if i is None else i for i in ids], np.int64)

    def _slices(self, most: int) -> Iterator[tuple[int, int]]:
        """Ranges of window starts: of several texts, or of a part of one."""
        lo = hi = 0
        for begin, size in zip(self.begin.tolist(), self.size.tolist(), strict=True):
            if hi > lo and begin + size + 1 - lo > most:
                yield lo, hi
                lo = hi
            hi = begin + size + 1
            while hi - lo > most:
                yield lo, lo + most
                lo += most
        if hi > lo:
            yield lo, hi

    def scan(self, most: int = SLICE) -> None:
        """The stretches of all texts: first and last window start, rank of the anchor, name, document."""
        width, half, found = self.width, self.half, []
        for lo, hi in self._slices(most):
            part = self.data[lo : hi + width - 1]
            n = len(part) - width + 1
            if n <= 0:
                continue
            h = ranks(part, half)
            bits = _U(int(len(h)).bit_length())
            least = _least_of((h >> bits << bits) | np.arange(len(h), dtype=_U), width - half + 1)
            anchor = (least & ((_U(1) << bits) - _U(1))).astype(np.int64)
            whole = np.ones(n, bool)
            for gap in np.flatnonzero(part == _GAP).tolist():
                whole[max(gap - width + 1, 0) : gap + 1] = False
            on = whole[1:] & whole[:-1] & (anchor[1:] == anchor[:-1])
            first = np.flatnonzero(whole & ~np.concatenate([[False], on]))
            last = np.flatnonzero(whole & ~np.concatenate([on, [False]]))
            step = width - half
            one, _ = paired(h[first], h[first + step])
            two, _ = paired(h[last], h[last + step])
            name, extra = paired(one, two, last - first)
            rank = mix64(h[anchor[first]])  # the least of many are small; buckets go by the upper bits
            # in text of one letter every window is a stretch: equal neighbours are one record
            same = (name[1:] == name[:-1]) & (extra[1:] == extra[:-1]) & (first[1:] == last[:-1] + 1)
            heads, tails = np.concatenate([[True], ~same])[: len(name)], np.concatenate([~same, [True]])[: len(name)]
            found.append((lo + first[heads], lo + last[tails], rank[heads], name[heads], extra[heads]))
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U), np.empty(0, _U), np.empty(0, np.uint16))
        self.first, self.last, self.rank, self.name, self.extra = (np.concatenate(x) for x in zip(*([none, *found]), strict=True))
        self.doc = self.order[np.searchsorted(self.begin, self.first, side="right") - 1] if len(self.first) else np.empty(0, np.int64)

    def _blobs(self, step: int, name: np.ndarray, columns: list[np.ndarray | None]) -> list[tuple]:
        """A row for each bucket of these ascending names."""
        bucket = ((name >> _U(32)) * _U(self.buckets) >> _U(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket)) + 1
        out = []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
            if b > a:
                out.append((step * self.buckets + int(bucket[a]), self.number, *[None if c is None else c[a:b].tobytes() for c in columns]))
        return out

    def _bits(self, step: int, name: np.ndarray) -> np.ndarray:
        """The replies for these ascending names, as _blobs sent them."""
        bucket = ((name >> _U(32)) * _U(self.buckets) >> _U(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket)) + 1
        got = [np.empty(0, np.uint8)]
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
            if b > a:
                got.append(np.unpackbits(np.frombuffer(self.replies[step * self.buckets + int(bucket[a])], np.uint8), count=b - a))
        return np.concatenate(got).astype(bool)

    def _docs(self, doc: np.ndarray) -> np.ndarray:
        return doc.astype(np.uint32) if len(doc) and doc.min() >= 0 and doc.max() < 1 << 32 else doc

    def rank_rows(self) -> list[tuple]:
        at, self.number_of, self.low, self.high = _distinct([self.rank], self.doc)
        self.keys = self.rank[at]
        return self._blobs(_RANK, self.keys, [self.keys.astype(np.uint32), None, None])

    def stretch_rows(self) -> list[tuple]:
        self.rank_rows()
        stay = (self._bits(_RANK, self.keys) | (self.low < self.high))[self.number_of]
        self.first, self.last, self.rank, self.name, self.extra, self.doc = (x[stay] for x in (self.first, self.last, self.rank, self.name, self.extra, self.doc))
        at, self.number_of, self.low, _ = _distinct([self.name, self.extra], self.doc)
        self.keys = self.name[at]
        rows = self._blobs(_STRETCH, self.keys, [self.keys, self.extra[at], self._docs(self.low)])
        at, self.anchor_of, least, most = _distinct([self.rank], self.name)
        self.anchors, self.many = self.rank[at], least != most
        own = np.where(self.many, _U(0), least >> _U(16) | _U(1))
        return rows + self._blobs(_ANCHOR, self.anchors, [self.anchors.astype(np.uint32), own.view(np.uint8).reshape(-1, 8)[:, :6], None])

    def window_rows(self) -> list[tuple]:
        self.stretch_rows()
        self.gone = self._bits(_STRETCH, self.keys)[self.number_of] | (self.doc > self.low[self.number_of])
        some = np.flatnonzero(~self.gone & (self._bits(_ANCHOR, self.anchors) | self.many)[self.anchor_of])
        n = self.last[some] - self.first[some] + 1
        self.at = np.repeat(self.first[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        name, extra = paired(ranks_at(self.data, self.at, self.half), ranks_at(self.data, self.at + self.width - self.half, self.half))
        self.at_doc = np.repeat(self.doc[some], n)
        at, self.at_number, self.at_low, _ = _distinct([name, extra], self.at_doc)
        self.at_keys = name[at]
        return self._blobs(_WINDOW, self.at_keys, [self.at_keys, extra[at], self._docs(self.at_low)])

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Maximal removed runs of bytes, as [first, last) within the data."""
        self.window_rows()
        windows = self.at[self._bits(_WINDOW, self.at_keys)[self.at_number] | (self.at_doc > self.at_low[self.at_number])]
        first, last = np.concatenate([self.first[self.gone], windows]), np.concatenate([self.last[self.gone], windows]) + self.width
        order = np.argsort(first, kind="stable")
        first, reach = first[order], np.maximum.accumulate(last[order]) if len(order) else last
        new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]])[: len(first)])
        return first[new], reach[np.append(new[1:] - 1, len(reach) - 1)] if len(new) else reach


_BLOBS = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("names", pa.binary()), ("extra", pa.binary()), ("docs", pa.binary())])


def _pack(most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, k, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        ids: list[int | None] = []
        texts: list[bytes | None] = []
        held = 0

        def row() -> pa.RecordBatch:
            data = b"".join((t or b"") + bytes([_GAP]) for t in texts)
            columns = [[part << 32 | k], [ids], [[-1 if t is None else len(t) for t in texts]], [len(data)], [squeeze.compress(data)]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["chunk", "ids", "sizes", "bytes", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                text = text.as_py()
                if ids and held + len(text or b"") > most:
                    yield row()
                    ids, texts, held, k = [], [], 0, k + 1
                ids.append(doc_id)
                texts.append(text)
                held += len(text or b"") + 1
        if ids:
            yield row()

    return pack


def _chunks(batch: pa.RecordBatch, width: int, buckets: int) -> Iterator[Chunk]:
    import zstandard

    replies = "replies" in batch.schema.names
    for k in range(len(batch)):
        row = {c: batch.column(batch.schema.get_field_index(c))[k] for c in ("chunk", "ids", "sizes", "bytes", "data", *["replies"] * replies)}
        known = {r["key"]: r["bits"] for r in (row["replies"].as_py() or [])} if replies else {}
        data = zstandard.ZstdDecompressor().decompress(row["data"].as_py(), max_output_size=row["bytes"].as_py())
        chunk = Chunk(row["chunk"].as_py(), row["ids"].as_py(), row["sizes"].as_py(), data, width, buckets, known)
        chunk.scan()
        yield chunk


def _sender(rows: str, width: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch, width, buckets):
                sent = getattr(chunk, rows)()
                if sent:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sent, strict=True), _BLOBS, strict=True)], schema=_BLOBS)

    return send


def _judge(buckets: int):
    def judge(group: pa.Table) -> pa.Table:
        """One bucket of names of all chunks: a bit for each name."""
        step = group.column("key")[0].as_py() // buckets
        names, extra, docs = (group.column(c).to_pylist() for c in ("names", "extra", "docs"))
        key = np.concatenate([np.frombuffer(x, np.uint32 if step in (_RANK, _ANCHOR) else _U) for x in names])
        n = [len(x) // key.itemsize for x in names]
        if step == _RANK:
            at, number, _, _ = _distinct([key], key)
            bits = (np.bincount(number, minlength=len(at)) > 1)[number]
        elif step == _ANCHOR:
            own = np.zeros((len(key), 8), np.uint8)
            own[:, :6] = np.frombuffer(b"".join(extra), np.uint8).reshape(-1, 6)
            _, number, low, high = _distinct([key], own.view(_U).ravel())
            bits = (low != high)[number]
        else:
            doc = np.concatenate([np.frombuffer(d, np.uint32 if len(d) == 4 * k else np.int64).astype(np.int64) for d, k in zip(docs, n, strict=True)])
            _, number, low, _ = _distinct([key, np.frombuffer(b"".join(extra), np.uint16)], doc)
            bits = low[number] < doc
        bounds = np.cumsum([0, *n])
        packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({"chunk": group.column("chunk"), "key": group.column("key"), "bits": pa.array(packed, pa.binary())})

    return judge


def _finish(width: int, buckets: int, digest: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch, width, buckets):
                first, last = chunk.spans()
                lo = np.searchsorted(first, chunk.begin)
                hi = np.append(lo[1:], len(first))
                removed, kept = [], []
                for t, (begin, size) in enumerate(zip(chunk.begin.tolist(), chunk.size.tolist(), strict=True)):
                    a, b = first[lo[t] : hi[t]].tolist(), last[lo[t] : hi[t]].tolist()
                    rest = b"".join(chunk.data[x:y].tobytes() for x, y in zip([begin, *b], [*a, begin + size], strict=True))
                    removed.append(size - len(rest))
                    kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk.ids, pa.int64()), pa.array(chunk.size), pa.array(removed, pa.int64()), pa.array(hi - lo), pa.array(kept, pa.string() if digest else pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return finish


def dedup(docs: DataFrame, width: int = WIDTH, digest: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of each row: the bytes left, or (digest) their SHA-256.

    A byte goes if a string of ``width`` bytes covers it that also starts in a document of a smaller
    doc_id; strings are judged on the input, do not cross documents, and may cut characters. Rows of
    equal doc_id are not before one another, so repeated rows keep all that no smaller doc_id has. A
    null doc_id is after all others. A null or empty text has no bytes and loses none. An empty table
    gives an empty result; other columns are ignored. Widths below 16 are refused.
    """
    if width < 16:
        raise ValueError("width must be at least 16 bytes")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = scratch.write(map_arrow(thin, _pack(chunk_bytes), "chunk long, ids array<long>, sizes array<long>, bytes long, data binary"), "packed")
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    parts = partitions(spark)
    buckets = max(4 * parts, -(-int(total) // NAMES_BYTES))
    # bucketed by chunk: all later passes join replies to it without moving text
    name = f"chunks_{uuid.uuid4().hex}"
    packed.repartition(parts, "chunk").write.format("parquet").bucketBy(parts, "chunk").option("path", scratch.path("chunks")).option("compression", "none").saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files are the scratch folder's
    scratch.drop("packed")
    replies: DataFrame | None = None

    def known() -> DataFrame:
        if replies is None:
            return chunks
        lists = replies.groupBy("chunk").agg(F.collect_list(F.struct("key", "bits")).alias("replies"))
        return chunks.join(lists.hint("shuffle_hash"), "chunk", "left")

    for rows in ("rank_rows", "stretch_rows", "window_rows"):
        sent = map_arrow(known(), _sender(rows, width, buckets), "key long, chunk long, names binary, extra binary, docs binary")
        got = scratch.write(map_groups(sent, "key", _judge(buckets), "chunk long, key long, bits binary"), rows)
        replies = got if replies is None else replies.unionByName(got)
    return scratch.keep(map_arrow(known(), _finish(width, buckets, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True).withColumnRenamed("kept", "kept_sha256")


#: Every string of 50 bytes, in hexadecimal and put together by doubling, with the smallest doc_id that has it.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(COALESCE(text, ''))), '..') AS b FROM documents),
k1 AS (SELECT doc_id, unnest(range(1, len(b) + 1)) AS i, unnest(b) AS s1 FROM d),
k2 AS (SELECT *, s1 || LEAD(s1, 1) OVER (PARTITION BY doc_id ORDER BY i) AS s2 FROM k1),
k4 AS (SELECT *, s2 || LEAD(s2, 2) OVER (PARTITION BY doc_id ORDER BY i) AS s4 FROM k2),
k8 AS (SELECT *, s4 || LEAD(s4, 4) OVER (PARTITION BY doc_id ORDER BY i) AS s8 FROM k4),
k16 AS (SELECT doc_id, i, s1, s2, s8 || LEAD(s8, 8) OVER (PARTITION BY doc_id ORDER BY i) AS s16 FROM k8),
k AS (SELECT doc_id, i, s1, md5(s16 || LEAD(s16, 16) OVER w || LEAD(s16, 32) OVER w || LEAD(s2, 48) OVER w) AS h FROM k16 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT h, MIN(doc_id) AS least FROM k WHERE h IS NOT NULL GROUP BY h),
c AS (SELECT doc_id, i, s1, COALESCE(MAX((least < doc_id)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM k LEFT JOIN m USING (h)),
e AS (SELECT *, gone AND NOT COALESCE(LAG(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
g AS (SELECT doc_id, COUNT(*) FILTER (gone) AS n_removed, COUNT(*) FILTER (opens) AS n_spans, string_agg(s1, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, len(b)::BIGINT AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(COALESCE(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
