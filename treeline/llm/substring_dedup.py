"""Removal of passages of 35 words that occur more than once, by repeated-phrase automata.

Windows of 35 words are judged in runs. A run is what one anchor covers: the 8-word gram of the
least hash in a window, leftmost of equals. Equal windows have equal anchors at equal offsets, so a
window can only recur under a recurring anchor, and two windows of one run are never equal.

1. Anchors are counted over all documents with the least and greatest hash of the words of their
   runs. An anchor of one run is unique. An anchor whose runs are all the same words is a confirmed
   recurring passage; one whose runs differ is open.
2. Documents are dealt to buckets of bounded size by hash, and with them one occurrence of each
   confirmed or open passage of the bucket. Each bucket compiles its shard of the passages into an
   Aho-Corasick automaton and streams all its documents through it, which finds every occurrence.
3. Windows of open passages are counted by their own hashes (96 bits) over all documents; those that
   recur are removed too.

A passage in a third of all documents gives one counted row for each batch in step 1 and one pattern
for each bucket in step 2. Rows equal in doc_id and text that are too many for a bucket are spread over
several, each with the row's patterns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, hide, map_arrow, map_groups, partitions
from .words import Words, blocks, by_bytes, sequence_hash, starts_of, words_of

WIDTH, GRAM = 35, 8
#: Bytes of text in a bucket, on average; a longer text is a bucket's only large one.
BUCKET_BYTES = 1_500_000


def _sliding_least(value: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of each ``width`` consecutive values."""
    at = np.arange(len(value))
    have, v = 1, value
    while have < width:
        step = min(have, width - have)
        left, right = slice(0, len(v) - step), slice(step, None)
        take = v[right] < v[left]
        at = np.where(take, at[right], at[left])
        v = np.where(take, v[right], v[left])
        have += step
    return at


def runs_of(words: Words, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text, anchor hash, run hash) of each run of windows."""
    at, text = starts_of(words, width)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    n = len(words.hash)
    known = blocks(words.hash, max(width, 2 * width - gram))  # the longest run
    grams = sequence_hash(words.hash, np.arange(n - gram + 1), gram, known=known)
    least = _sliding_least(grams, width - gram + 1)[at]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(at)))
    first, size = at[begin], windows + width - 1
    return first, size, text[begin], grams[least[begin]].view(np.int64), sequence_hash(words.hash, first, size, known=known).view(np.int64)


def _anchor_rows(width: int, gram: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 0):
                _, _, _, anchor, run = runs_of(words_of(part.column(0)), width, gram)
                if len(anchor):
                    order = np.lexsort((run, anchor))
                    anchor, run = anchor[order], run[order]
                    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])]))
                    n = np.diff(np.append(new, len(anchor)))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), pa.array(run[new]), pa.array(n)], ["anchor", "run", "n"])

    return count


def _reference_rows(width: int, gram: int):
    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One occurrence of each run for each bucket and chunk."""
        for batch in batches:
            for part in by_bytes(batch, 2):
                words = words_of(part.column(2))
                first, size, text, anchor, run = runs_of(words, width, gram)
                if not len(anchor):
                    continue
                bucket, row = part.column(0).to_numpy(zero_copy_only=False)[text], part.column(1).to_numpy(zero_copy_only=False)[text]
                order = np.lexsort((run, anchor, bucket))
                a, r, b = anchor[order], run[order], bucket[order]
                order = order[np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1]) | (b[1:] != b[:-1])])]
                place = (first - words.first[:-1][text])[order] << 32 | size[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[order]), pa.array(bucket[order]), pa.array(row[order]), pa.array(place)], ["anchor", "bucket", "row", "place"]
                )

    return refer


class Automaton:
    """Aho-Corasick over words: each word is two letters, the first and second from different alphabets, so no hit is out of step."""

    def __init__(self, hashes: np.ndarray):
        ids = np.unique(hashes, return_inverse=True)[1] if len(hashes) else np.empty(0, np.int64)
        base = int(np.sqrt(ids.max() if len(ids) else 0)) + 1
        letters = np.empty(2 * len(ids), np.uint32)
        letters[0::2] = 0x10000 + ids // base
        letters[1::2] = 0x10000 + base + ids % base
        self.text = letters.tobytes().decode("utf-32-le")
        self.known: dict[str, int] = {}
        self.size: list[int] = []
        self.open: list[bool] = []

    def add(self, first: int, size: int, open_: bool) -> None:
        phrase = self.text[2 * first : 2 * (first + size)]
        if phrase not in self.known:
            self.known[phrase] = len(self.size)
            self.size.append(size)
            self.open.append(open_)

    def compile(self) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase, k in self.known.items():
            self.machine.add_word(phrase, k)
        self.machine.make_automaton()

    def hits(self, first: int, last: int) -> Iterator[tuple[int, int, bool]]:
        """(first word from ``first`` on, words, open) of each occurrence between two words."""
        if self.known:
            for end, k in self.machine.iter(self.text[2 * first : 2 * last]):
                size = self.size[k]
                yield (end + 1) // 2 - size, size, self.open[k]


def _kept(words: Words, t: int, removed: np.ndarray) -> str:
    at = np.flatnonzero(~removed) + words.first[t]
    data = words.data
    return b" ".join([data[a:b].tobytes() for a, b in zip(words.start[at], words.end[at], strict=True)]).decode("utf-8", "replace") if len(at) else ""


def _cover(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n words some [first, last) covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    return np.cumsum(step[:-1]) > 0


def _window_hashes(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows at these words, of 64 and 32 bits."""
    return sequence_hash(hashes, at, width).view(np.int64), (sequence_hash(hashes, at, width, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _text_or_digest(kept: list[str], digest: bool) -> pa.Array:
    return pa.array([hashlib.sha256(x.encode()).hexdigest() if digest else x for x in kept], pa.string())


def _locate(names: list[str], width: int, digest: bool):
    def locate(group: pa.Table) -> pa.Table | None:
        """One bucket: its passages (rows with a place) and its documents."""
        place = group.column("_place")
        is_doc = np.asarray(place.is_null())
        docs = group.filter(pa.array(is_doc))
        if not docs.num_rows:
            return None
        refs = group.filter(pa.array(~is_doc))
        words = words_of(docs.column("text"))
        row_at = {r: t for t, r in enumerate(docs.column("_row").to_pylist())}
        machine = Automaton(words.hash)
        for row, where, open_ in zip(refs.column("_row").to_pylist(), refs.column("_place").to_pylist(), refs.column("_open").to_pylist(), strict=True):
            t = row_at.get(row)
            if t is not None:
                machine.add(int(words.first[t]) + (where >> 32), where & 0xFFFFFFFF, open_)
        machine.compile()
        n_words, n_removed, kept, open_first, open_hash, cover = [], [], [], [], [], []
        for t in range(docs.num_rows):
            a, b = int(words.first[t]), int(words.first[t + 1])
            sure_first, sure_last, windows = [], [], []
            for first, size, open_ in machine.hits(a, b):
                if open_:
                    windows.append(np.arange(first, first + size - width + 1))
                else:
                    sure_first.append(first)
                    sure_last.append(first + size)
            removed = _cover(b - a, np.array(sure_first, np.int64), np.array(sure_last, np.int64))
            n_words.append(b - a)
            if windows:
                at = np.unique(np.concatenate(windows))
                open_first.append(at.astype(np.int32))
                open_hash.append(_window_hashes(words.hash[a:b], at, width))
                cover.append(np.flatnonzero(np.diff(np.concatenate([[False], removed, [False]]).astype(np.int8))).astype(np.int32))
                n_removed.append(None)
                kept.append(None)
            else:
                open_first.append(None)
                cover.append(None)
                n_removed.append(int(removed.sum()))
                text = _kept(words, t, removed)
                kept.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
        is_open = [x is not None for x in open_first]
        text = docs.column("text").to_pylist()
        out = {c: docs.column(c) for c in ["_bucket", *names] if c != "text"}
        out |= {
            "_n_words": pa.array(n_words, pa.int64()), "_n_removed": pa.array(n_removed, pa.int64()), "_kept": pa.array(kept, pa.string()),
            "_text": pa.array([x if o else None for x, o in zip(text, is_open, strict=True)], pa.string()),
            "_first": pa.array(open_first, pa.list_(pa.int32())), "_hash": pa.nulls(len(kept), pa.list_(pa.int64())), "_hash2": pa.nulls(len(kept), pa.list_(pa.int32())), "_cover": pa.array(cover, pa.list_(pa.int32())),
        }
        out = pa.table(out)
        if not open_hash:
            return out
        # one row more: the different open windows of the bucket (_hash, _hash2) and how often each is there (_first)
        one, two = (np.concatenate(h) for h in zip(*open_hash, strict=True))
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        n = np.diff(np.append(new, len(one)))
        own = {
            "_bucket": group.column("_bucket")[:1], "_hash": pa.array([one[new]], pa.list_(pa.int64())), "_hash2": pa.array([two[new]], pa.list_(pa.int32())),
            "_first": pa.array([n.astype(np.int32)], pa.list_(pa.int32())),
        }
        return pa.concat_tables([out, pa.table({c: own.get(c, pa.nulls(1, out.schema.field(c).type)) for c in out.column_names})])

    return locate


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Rows of a list column as int64 arrays, null as an empty one."""
    if not len(column):
        return []
    whole = pa.concat_arrays(column.chunks)
    sizes = pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False)
    return np.split(whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes)[:-1])


def _finish(columns: list[str], width: int, digest: bool):
    def finish(group: pa.Table) -> pa.Table | None:
        """One bucket: the hashes of its windows that recur (one row) and its open documents."""
        is_doc = np.asarray(group.column("_text").is_valid())
        docs, rest = group.filter(pa.array(is_doc)), group.filter(pa.array(~is_doc))
        if not docs.num_rows:
            return None
        again, again2 = (np.concatenate([np.empty(0, np.int64), *_lists(rest.column(c))]) for c in ("_hash", "_hash2"))
        order = np.argsort(again, kind="stable")
        again, again2 = again[order], again2[order]
        words = words_of(docs.column("_text"))
        gone, kept = [], []
        for t, (edges, first) in enumerate(zip(_lists(docs.column("_cover")), _lists(docs.column("_first")), strict=True)):
            a, b = int(words.first[t]), int(words.first[t + 1])
            n, more = b - a, first[:0]
            if len(again):
                one, two = _window_hashes(words.hash[a:b], first, width)
                at = np.minimum(np.searchsorted(again, one), len(again) - 1)
                more = first[(again[at] == one) & (again2[at] == two)]
            removed = _cover(n, np.concatenate([edges[0::2], more]), np.concatenate([edges[1::2], more + width]))
            gone.append(int(removed.sum()))
            kept.append(_kept(words, t, removed))
        out = {c: docs.column(c) for c in [*columns, "_n_words"]}
        return pa.table(out | {"_n_removed": pa.array(gone, pa.int64()), "_kept": _text_or_digest(kept, digest)})

    return finish


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, digest: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` but text, plus _n_words, _n_removed and _kept: the kept words joined by one space, or (digest) their SHA-256.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of ``width`` words covers it
    whose words also start anywhere else, in the same text or another; windows are judged on the
    input. A null, empty or short text has no window and keeps its words. Rows equal in doc_id and text are rows of
    their own, so their windows recur. Null doc_ids are rows like others. An empty table gives an
    empty result. Other columns pass through, and one of a name that is added is replaced.
    """
    spark = docs.sparkSession
    docs, back = hide(docs, "doc_id", "text")
    scratch = Scratch(spark, "substring-dedup")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, partitions(spark), -(-int(total) // bucket_bytes))
    # two hashes name a row: one is its key, the other picks its bucket, and only rows of one bucket meet
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text")).withColumn("_other", F.xxhash64(F.lit("bucket"), "text", "doc_id"))
    name = ["_row", "_other"]
    # rows equal in doc_id and text that fill more than a bucket, and over how many buckets they go
    heavy = keyed.groupBy(*name).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).filter((F.col("n") > 1) & (F.col("bytes") > bucket_bytes))
    heavy = scratch.write(heavy.select(*name, F.ceil(F.col("bytes") / bucket_bytes).cast("int").alias("_parts")), "heavy")
    place = lambda h: F.pmod(h, F.lit(buckets)).cast("long")
    texts = keyed.filter("text is not null")
    marked = keyed.withColumn("_bucket", place(F.col("_other")))
    known = texts.select(place(F.col("_other")).alias("_bucket"), "_row", "text")
    if not heavy.isEmpty():
        part = F.xxhash64("_other", "_part")
        # equal rows are told apart by their order only, so their parts are written before anything reads them: a task that runs again finds the same
        hot = scratch.write(keyed.join(heavy, name).withColumn("_part", F.monotonically_increasing_id() % F.col("_parts")), "hot")
        cold = lambda df: df.join(heavy.select(*name), name, "left_anti")
        marked = cold(marked).unionByName(hot.withColumn("_bucket", place(part)).drop("_part", "_parts"))
        once = hot.groupBy(*name, "_parts").agg(F.first("text").alias("text")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts").cast("long") - 1)))
        known = cold(texts).select(place(F.col("_other")).alias("_bucket"), "_row", "text").unionByName(once.select(place(part).alias("_bucket"), "_row", "text"))
    counted = map_arrow(docs.select("text").filter("text is not null"), _anchor_rows(width, gram), "anchor long, run long, n long")
    counted = counted.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("run").alias("low"), F.max("run").alias("high")).filter("n > 1")
    anchors = scratch.write(counted.select("anchor", (F.col("low") != F.col("high")).alias("open")), "anchors")
    refs = map_arrow(known, _reference_rows(width, gram), "anchor long, bucket long, row long, place long")
    refs = refs.join(anchors, "anchor").select(F.col("bucket").alias("_bucket"), F.col("row").alias("_row"), F.col("place").alias("_place"), F.col("open").alias("_open"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields]
    both = marked.select("_bucket", "_row", F.lit(None).cast("long").alias("_place"), F.lit(None).cast("boolean").alias("_open"), *docs.columns).unionByName(
        refs.select("_bucket", "_row", "_place", "_open", *empty)
    )
    columns = [c for c in docs.columns if c != "text"]
    fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name != "text"]
    long, text = T.LongType(), T.StringType()
    done = [T.StructField("_n_words", long), T.StructField("_n_removed", long), T.StructField("_kept", text)]
    opened = [T.StructField("_text", text), T.StructField("_first", T.ArrayType(T.IntegerType())), T.StructField("_hash", T.ArrayType(long)), T.StructField("_hash2", T.ArrayType(T.IntegerType())), T.StructField("_cover", T.ArrayType(T.IntegerType()))]
    spread = max(partitions(spark), min(buckets, 4 * partitions(spark)))
    located = map_groups(both, "_bucket", _locate(docs.columns, width, digest), T.StructType([T.StructField("_bucket", long), *fields, *done, *opened]), spread=spread)
    located = scratch.write(located, "located")
    ready = located.filter("_text is null and _n_words is not null").select(*columns, "_n_words", "_n_removed", "_kept")
    waiting = located.filter("_text is not null").select("_bucket", *columns, "_n_words", "_cover", "_first", "_hash", "_hash2", "_text")
    # a window in very many documents is one row for each bucket, counted and judged there
    windows = located.filter("_n_words is null").select("_bucket", F.explode(F.arrays_zip("_hash", "_hash2", "_first")).alias("w"))
    windows = windows.select("_bucket", F.col("w._hash").alias("hash"), F.col("w._hash2").alias("hash2"), F.col("w._first").alias("n"))
    again = windows.groupBy("hash", "hash2").agg(F.sum("n").alias("n")).filter("n > 1").select("hash", "hash2")
    again = windows.select("_bucket", "hash", "hash2").join(again, ["hash", "hash2"]).groupBy("_bucket").agg(F.collect_list(F.struct("hash", "hash2")).alias("w"))
    again = again.select("_bucket", F.col("w.hash").alias("_hash"), F.col("w.hash2").alias("_hash2"))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in waiting.schema.fields}
    both = waiting.unionByName(again.select("_bucket", *[c for n, c in empty.items() if n not in ("_bucket", "_hash", "_hash2")], "_hash", "_hash2"))
    finished = map_groups(both, "_bucket", _finish(columns, width, digest), T.StructType([*fields, *done]), spread=spread)
    return scratch.keep(back(ready.unionByName(finished), "_n_words", "_n_removed", "_kept", without=("text",)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, digest=True).select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring passages; n_chars follows the text. A document of nothing else stays, with an empty text."""
    slim, back = hide(docs, "doc_id", "text", "n_chars")
    kept = dedup(slim).withColumn("text", F.col("_kept")).withColumn("n_chars", F.length("text").cast("long"))
    return back(kept)
