"""Self-join of documents on Jaccard similarity of their word 5-gram sets: MinHash banding, then verification.

1. Each text gives its shingle set, a 128-bit key of that set, one hash for each band of its MinHash
   signature, and a byte of each of the signature's minima. Bands and rows are chosen for a target recall
   at the threshold.
2. Texts of equal sets become one node with a count of copies; rows equal in doc_id and text are one.
3. Nodes are shuffled on band hashes. Within a bucket the signatures are compared, in tiles if it is large:
   a pair is plausible if no fewer minima agree than chance allows at the threshold. A bucket returns a
   spanning forest of its plausible pairs; texts that share a band but not much more are not tied.
4. Ties are closed to candidate groups. A group is cut by hash into tiles; each pair of tiles compares
   its texts' full sets in one matrix product. Tiles return counts of links and a spanning forest,
   never the pairs.
5. The forests of all tiles are closed to classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hide, map_arrow, map_groups, map_runs
from .components import components
from .words import by_bytes, mix64, shingle_sets, words_of

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Texts and shingles in a tile at most, but for single texts that are larger; signatures in a bucket's tile.
TILE_TEXTS, TILE_SHINGLES, TILE_SIGNATURES = 256, 400_000, 512
#: Standard deviations that a signature's agreement may fall short at the threshold: about one pair in ten million.
SHORT = 5.5


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands keep the target recall at the threshold."""
    best = (1, 1)
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5150)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def band_hashes(sets: np.ndarray, begin: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """[text, band] for the texts with shingles, each of ``rows`` minima of 64-bit hashes, and a byte of each minimum."""
    some = np.flatnonzero(np.diff(begin) > 0)
    out, signature = np.zeros((len(begin) - 1, bands), np.uint64), np.zeros((len(begin) - 1, bands * rows), np.uint8)
    if not len(some):
        return out, signature
    a, b = _multipliers(bands * rows)
    with np.errstate(over="ignore"):
        for band in range(bands):
            h = np.full(len(some), 0x51ED2701 + band, np.uint64)
            for k in range(band * rows, band * rows + rows):
                low = np.minimum.reduceat((sets * a[k] + b[k]) ^ (sets >> np.uint64(32)), begin[:-1][some])
                h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + low)
                signature[some, k] = low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
            out[some, band] = h
    return out, signature


def least_agreement(hashes: int, threshold: float) -> int:
    """How many of so many minima a pair at the threshold shares at least."""
    return max(1, math.floor(hashes * threshold - SHORT * math.sqrt(hashes * threshold * (1 - threshold))))


def set_keys(sets: np.ndarray, begin: np.ndarray) -> list[bytes | None]:
    return [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(begin[:-1], begin[1:], strict=True)]


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, set_key and set_id (its first half; null without words), n (shingles), bands, signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 2):
                sets, begin = shingle_sets(words_of(part.column(2)), WIDTH)
                hashes, signature = band_hashes(sets, begin, bands, rows)
                flat = pa.array(hashes.ravel().view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * bands, pa.int32()), flat)
                keys = set_keys(sets, begin)
                ids = pa.array([k and int.from_bytes(k[:8], "big", signed=True) for k in keys], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), ids, pa.array(np.diff(begin), pa.int64()), lists, pa.array([x.tobytes() for x in signature], pa.binary())],
                    ["doc_id", "text_hash", "set_key", "set_id", "n", "bands", "signature"],
                )

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(thin, sign, "doc_id long, text_hash long, set_key binary, set_id long, n long, bands array<long>, signature binary")


def _tie(least: int):
    def tie(batch: pa.Table) -> pa.Table | None:
        """Whole buckets or pairs of their tiles (rows of one task): a spanning forest of the plausible pairs of each, a and b."""
        task = batch.column("task").to_numpy()
        side = batch.column("side").to_numpy()
        ids = batch.column("set_id").to_numpy()
        signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
        begin = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        size = np.diff(np.append(begin, len(task)))
        two = begin[size == 2]
        near = two[(signature[two] == signature[two + 1]).sum(1) >= least]
        a, b = [ids[near]], [ids[near + 1]]
        for lo, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own, known = signature[lo : lo + n], ids[lo : lo + n]
            left = np.flatnonzero(side[lo : lo + n] == 0)
            right = np.flatnonzero(side[lo : lo + n] == 1) if side[lo : lo + n].any() else left
            agree = np.zeros((len(left), len(right)), np.int16)
            for k in range(own.shape[1]):
                agree += own[left, None, k] == own[None, right, k]
            i, j = np.nonzero(agree >= least)
            rank = np.argsort(np.argsort(known, kind="stable"), kind="stable")
            root = forest(n, rank[left[i]], rank[right[j]])
            ordered = np.sort(known)
            some = np.flatnonzero(root != np.arange(n))
            a.append(ordered[some])
            b.append(ordered[root[some]])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": a, "b": b}) if len(a) else None

    return tie


def compare(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b; or i < j of a) with Jaccard similarity >= threshold of the full sets."""
    both = sets_a + (sets_b or [])
    n_a, sizes = len(sets_a), np.array([len(s) for s in both], np.int64)
    everything = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    new = np.concatenate([[True], everything[1:] != everything[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one text meets nothing
    column, owner = column[shared], owner[shared]
    hits = np.zeros((n_a, len(both) if sets_b is None else len(sets_b)), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        for lo in range(0, int(column[-1]) + 1, 20_000):
            a, b = np.searchsorted(column, [lo, lo + 20_000])
            matrix = np.zeros((len(both), min(20_000, int(column[-1]) + 1 - lo)), np.float32)
            matrix[owner[a:b], column[a:b] - lo] = 1
            hits += matrix[:n_a] @ (matrix if sets_b is None else matrix[n_a:]).T
    other = sizes if sets_b is None else sizes[n_a:]
    union = sizes[:n_a, None] + other[None, :] - hits
    linked = hits >= threshold * union - 1e-9
    linked &= hits > 0
    if sets_b is None:
        linked = np.triu(linked, 1)
    return np.nonzero(linked)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches by the links i-j."""
    root = np.arange(n)
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    return root


def _verify(threshold: float):
    def verify(group: pa.Table) -> pa.Table | None:
        """Rows of one pair of tiles: set_key, side (0, 1; all 0 in a tile with itself), copies, text."""
        sets, begin = shingle_sets(words_of(group.column("text")), WIDTH)
        keys, made = group.column("set_key").to_pylist(), set_keys(sets, begin)
        side, copies = group.column("side").to_pylist(), group.column("copies").to_pylist()
        at: dict[tuple[int, bytes], int] = {}
        for k, (key, own) in enumerate(zip(keys, made, strict=True)):
            if key == own:  # another text with the same ids is not this node
                at.setdefault((side[k], key), k)
        rows = [at[x] for x in sorted(at)]
        a, b = [k for k in rows if side[k] == 0], [k for k in rows if side[k] == 1]
        crossed = "cross" in group.column("kind").to_pylist()[:1]
        if crossed and not (a and b) or len(a) < 1:
            return None
        of = [sets[begin[k] : begin[k + 1]] for k in a + b]
        i, j = compare(of[: len(a)], of[len(a) :] if crossed else None, threshold)
        j = j + len(a) * crossed
        order = a + b
        weight = np.array([copies[k] for k in order], np.int64)
        links = np.zeros(len(order), np.int64)
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        rank = sorted(range(len(order)), key=lambda x: keys[order[x]])
        place = np.empty(len(order), np.int64)
        place[rank] = np.arange(len(order))
        root = forest(len(order), place[i], place[j])
        some = np.flatnonzero(links > 0)
        if not len(some):
            return None
        return pa.table(
            {
                "set_key": pa.array([keys[order[k]] for k in some], pa.binary()),
                "links": pa.array(links[some]),
                "root": pa.array([keys[order[rank[root[place[k]]]]] for k in some], pa.binary()),
            }
        )

    return verify


def plausible(sets: DataFrame, least: int) -> DataFrame:
    """sets: set_id, bands, signature -> a, b: ties of those that share a band and at least so many minima, a forest of each bucket's tile."""
    # a band's number is in its hash
    banded = sets.select("set_id", F.explode("bands").alias("h"))
    # sets that share half a key may share a group: groups are where to look, no more
    buckets = banded.groupBy("h").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most"), F.count(F.lit(1)).alias("m")).filter("least <> most")
    shared = banded.join(buckets.select("h", F.ceil(F.col("m") / TILE_SIGNATURES).cast("int").alias("tiles")), "h")
    shared = shared.join(sets.select(F.col("set_id").alias("s_id"), "signature"), F.col("set_id") == F.col("s_id")).withColumn("tile", F.pmod(F.xxhash64("set_id"), F.col("tiles")).cast("int"))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        F.when(F.col("tiles") == 1, F.col("h")).otherwise(F.xxhash64("h", F.least("tile", "other"), F.greatest("tile", "other"))).alias("task"),
        F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"), "set_id", "signature",
    )
    return map_runs(shared, "task", _tie(least), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, Scratch]:
    """(rows, nodes): doc_id, text_hash, set_key of each row; and set_key, class_key, class_id, copies, n_links of each different set.

    class_id is the smallest doc_id of the class, class_key the smallest set_key of it; n_links counts
    the rows that a row is linked with, rows of the same set included. A text without words (null,
    empty, white space) has no set_key and is linked with nothing. A text of fewer than five words is
    one shingle. Null doc_ids are rows like others, which name a class only if it has no other; equal
    doc_ids are rows like others. An empty table gives empty results; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    bands, rows = banding(threshold, recall)
    every = scratch.write(signed(docs, bands, rows), "signed")
    # equal sets have equal bands and signatures
    sets = every.filter("set_key is not null").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("of"),
        F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "set_id", "bands", "signature")],
    )
    sets = scratch.write(sets.select("set_key", "set_id", "of.doc_id", "of.text_hash", "copies", "n", "bands", "signature"), "sets")
    groups = components(plausible(sets, least_agreement(bands * rows, threshold)), scratch, "ties")
    # tiles of each candidate group, by hash
    size = sets.join(groups, sets["set_id"] == groups["node"]).select("set_key", "doc_id", "text_hash", "copies", "n", F.col("root").alias("grp"))
    totals = size.groupBy("grp").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"))
    totals = totals.withColumn("tiles", F.greatest(F.ceil(F.col("texts") / TILE_TEXTS), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int"))
    members = size.join(totals.select("grp", "tiles"), "grp").withColumn("tile", F.pmod(F.xxhash64("set_key"), F.col("tiles")).cast("int"))
    named = docs.select(F.col("doc_id").cast("long").alias("d_id"), F.xxhash64("text").alias("d_hash"), "text")
    m = members.alias("m")
    texts = named.join(m, F.col("d_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d_hash") == F.col("m.text_hash")))
    # rows equal in doc_id and text are one
    texts = texts.select("m.grp", "m.set_key", "m.tile", "m.tiles", "m.copies", "text").dropDuplicates(["set_key"])
    tiled = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        F.xxhash64("grp", F.least("tile", "other"), F.greatest("tile", "other")).alias("task"),
        F.when(F.col("tile") == F.col("other"), "self").otherwise("cross").alias("kind"),
        F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"),
        "set_key", "copies", "text",
    )
    found = map_groups(tiled, "task", _verify(threshold), "set_key binary, links long, root binary")
    found = scratch.write(found, "links")
    counts = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("set_key").alias("a"), F.col("root").alias("b")), scratch, "classes")
    nodes = sets.join(counts, "set_key", "left").join(classes.withColumnRenamed("node", "set_key"), "set_key", "left")
    nodes = nodes.select("set_key", "doc_id", "copies", F.coalesce("root", "set_key").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    nodes = scratch.write(nodes, "nodes")
    ids = nodes.groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    nodes = nodes.drop("doc_id").join(ids, "class_key")
    return every.select("doc_id", "text_hash", "set_key"), nodes, scratch


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links of each document."""
    rows, nodes, scratch = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = rows.filter("set_key is not null").join(nodes, "set_key").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links")
    alone = rows.filter("set_key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return scratch.keep(found.unionByName(alone))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest doc_id; documents without words all stay."""
    docs, back = hide(docs, "doc_id", "text")
    rows, nodes, scratch = near_duplicates(docs)
    # the rows that stay, by doc_id and text; equal rows count as one
    best = rows.filter("set_key is not null").join(nodes.select("set_key", "class_key"), "set_key")
    best = best.groupBy("class_key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("equal")).groupBy("class_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "equal")).alias("of")
    )
    best = scratch.write(best.select(F.col("of.doc_id").alias("_id"), F.col("of.text_hash").alias("_hash"), F.col("of.equal").alias("_equal")), "best")
    marked = docs.withColumn("_hash", F.xxhash64("text"))
    same = F.col("d.doc_id").eqNullSafe(F.col("b._id")) & (F.col("d._hash") == F.col("b._hash"))
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = marked.filter(some).alias("d").join(best.alias("b"), same).select("d.*", "b._equal")
    once = kept.filter("_equal = 1").unionByName(kept.filter("_equal > 1").dropDuplicates(["doc_id", "_hash"]))
    return scratch.keep(back(once.drop("_hash", "_equal").unionByName(docs.filter(~some))))
