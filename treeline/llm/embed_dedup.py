"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned so that the axes come by falling variance. Two tiles
accumulate the product of the leading axes first; the rest of a product is at most the product of
the two suffix norms (Cauchy-Schwarz), so pairs drop out, and a tile stops, as soon as the threshold
is out of reach. Pairs that stay are decided on the original vectors in double precision.

Tiles are the cells of a tree of splits of the leading axes, as deep as a label has rows. Two vectors
whose cosine reaches the threshold are at most sqrt(2 - 2 threshold) apart, so a vector is shipped
only to cells whose box is that near to it on the leading axes. A cell of too many rows is cut into
blocks by hash, so its size bounds no task. Equal vectors are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, map_groups
from .components import components
from .ngram_join import forest
from .vectors import cosines, matrix, usable

THRESHOLD = 0.98
#: Vectors in a block at most, on average, and in what two blocks compare at once.
BLOCK, AT_ONCE = 4096, 1024
#: Leading axes that the tree splits, its greatest depth, and the vectors (picked by hash) whose medians it splits at.
LEADING, MOST_DEPTH, SAMPLE = 8, 12, 50_000
#: Leading axes after which a tile looks whether any pair is still in reach.
STEPS = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension, the orthogonal turn to axes of falling variance; only sums of products (dims x dims) reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                x = matrix(batch.column(1).filter(pa.array(dims == dim)))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                sums[int(dim)] = sums.get(int(dim), 0) + x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))], ["dim", "products"]
        )

    partial = map_arrow(vectors.select("dim", "embedding"), add, "dim int, products array<double>")
    flat = partial.select("dim", F.posexplode("products").alias("at", "v")).groupBy("dim", "at").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for row in flat.groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("v")).collect():
        _, q = np.linalg.eigh(np.array(row.v).reshape(row.dim, row.dim))
        out[row.dim] = np.ascontiguousarray(q[:, ::-1])
    return out


def reach(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine is at least the threshold (i < j if both tiles are the same)."""
    dims = a.shape[1]
    rest_a = np.sqrt(np.maximum(np.cumsum((turned_a**2)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum((turned_b**2)[:, ::-1], axis=1)[:, ::-1], 0))
    product, done = np.zeros((len(a), len(b))), 0
    alive = np.triu(np.ones(product.shape, bool), 1) if same else np.ones(product.shape, bool)
    if not alive.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    for step in [s for s in STEPS if s < dims] + [dims]:
        product += turned_a[:, done:step] @ turned_b[:, done:step].T
        done = step
        bound = product + rest_a[:, step, None] * rest_b[None, :, step] if step < dims else product
        alive &= bound >= threshold - 1e-9
        left = int(alive.sum())
        if left == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if left * dims <= 4 * len(a) * len(b):  # few enough to decide one by one
            break
    i, j = np.nonzero(alive)
    sure = np.concatenate([cosines(a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) >= threshold
    return i[sure], j[sure]


class Splits:
    """A full binary tree over the leading axes: node k has children 2k and 2k + 1, the root is 1."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.axis, self.at = np.zeros(1 << depth, np.int32), np.zeros(1 << depth)
        held = {1: sample}
        for node in range(1, 1 << depth):
            x = held.pop(node, sample[:0])
            if len(x):
                self.axis[node] = int(np.argmax(x.std(axis=0)))
                self.at[node] = float(np.median(x[:, self.axis[node]]))
            low = x[:, self.axis[node]] <= self.at[node]
            held[2 * node], held[2 * node + 1] = x[low], x[~low]

    def cells(self, x: np.ndarray, depth: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell of each row at its depth; and row, cell of each cell whose box is within ``width`` of the row)."""
        own = np.ones(len(x), np.int64)
        for level in range(int(depth.max(initial=0))):
            deeper = depth > level
            right = x[np.arange(len(x)), self.axis[own % len(self.axis)]] > self.at[own % len(self.axis)]
            own[deeper] = 2 * own[deeper] + right[deeper]
        rows, found = [], []
        # rows that reach a node, and how far off its box they are on each axis, squared
        open_ = [(1, 0, np.arange(len(x)), np.zeros(x.shape))]
        while open_:
            node, level, at, off = open_.pop()
            here = depth[at] == level
            rows.append(at[here])
            found.append(np.full(int(here.sum()), node))
            at, off = at[~here], off[~here]
            if not len(at):
                continue
            a, gap = self.axis[node], x[at, self.axis[node]] - self.at[node]
            for side in (0, 1):
                beyond = np.maximum(gap, 0) if side == 0 else np.maximum(-gap, 0)
                away = off.copy()
                away[:, a] = np.maximum(away[:, a], beyond**2)
                near = away.sum(axis=1) <= width * width
                if near.any():
                    open_.append((2 * node + side, level + 1, at[near], away[near]))
        return own, np.concatenate(rows), np.concatenate(found)


def _compare(turns: dict[int, np.ndarray], threshold: float):
    def compare(group: pa.Table) -> pa.Table | None:
        """Rows of one pair of blocks: key, side (all 0 in a block with itself), cross, copies, embedding."""
        side = group.column("side").to_numpy()
        cross = group.column("cross")[0].as_py()
        x, keys, copies = matrix(group.column("embedding")), group.column("key").to_pylist(), group.column("copies").to_numpy()
        turned = x / np.linalg.norm(x, axis=1, keepdims=True) @ turns[x.shape[1]]
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if cross else a
        if not len(a) or not len(b):
            return None
        pairs = []
        for lo in range(0, len(a), AT_ONCE):
            for hi in range(0 if cross else lo, len(b), AT_ONCE):
                m, n = a[lo : lo + AT_ONCE], b[hi : hi + AT_ONCE]
                i, j = reach(x[m], x[n], turned[m], turned[n], threshold, not cross and lo == hi)
                pairs.append((m[i], n[j]))
        i, j = (np.concatenate(k) for k in zip(*pairs, strict=True))
        if not len(i):
            return None
        links = np.bincount(i, copies[j], len(keys)).astype(np.int64) + np.bincount(j, copies[i], len(keys)).astype(np.int64)
        rank = sorted(range(len(keys)), key=keys.__getitem__)
        place = np.empty(len(keys), np.int64)
        place[rank] = np.arange(len(keys))
        root = forest(len(keys), place[i], place[j])
        some = np.flatnonzero(links)
        return pa.table({"key": pa.array([keys[k] for k in some], pa.binary()), "links": pa.array(links[some]), "root": pa.array([keys[rank[root[place[k]]]] for k in some], pa.binary())})

    return compare


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding, label).

    Rows are compared if their labels are equal and not null and their vectors of one dimension. A
    vector that is null, empty, zero or holds null or non-finite components links with nothing and is
    its own component, as is a row without a label. Rows equal in vector and label are linked. Rows of
    one vec_id are rows like others; a null vec_id names a component only if it has no other. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "embed-dedup")
    fine = F.col("label").isNotNull() & usable(F.col("embedding"))
    # -0.0 equals 0.0
    whole = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))
    key = F.when(fine, F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), whole.cast("array<string>")).cast("binary"))))
    marked = rows.select("vec_id", "label", "embedding", key.alias("key"))
    nodes = marked.filter("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    nodes = scratch.write(nodes.withColumn("dim", F.size("embedding")), "nodes")
    turns = axes(nodes)
    width = math.sqrt(max(2 - 2 * threshold, 0)) + 1e-9
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = scratch.write(sizes.withColumn("depth", F.least(F.lit(MOST_DEPTH), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK)))).cast("int")), "sizes")
    # the deepest tree that a label needs, and a bounded sample of each dimension to split
    splits: dict[int, Splits] = {}
    for row in sizes.groupBy("dim").agg(F.max("depth").alias("depth"), F.sum("n").alias("n")).collect():
        lead = np.zeros((0, min(LEADING, row.dim)))
        if row.depth:
            picked = nodes.filter((F.col("dim") == row.dim) & (F.pmod(F.xxhash64("key"), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, SAMPLE / row.n)))).select("embedding")
            x = np.array([r.embedding for r in picked.limit(2 * SAMPLE).collect()], float)
            lead = x / np.linalg.norm(x, axis=1, keepdims=True) @ turns[row.dim][:, :LEADING]
        splits[row.dim] = Splits(lead, row.depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, depth = batch.column(2).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            own, near = np.ones(len(batch), np.int64), [None] * len(batch)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = matrix(batch.column(1).take(pa.array(at)))
                lead = x / np.linalg.norm(x, axis=1, keepdims=True) @ turns[int(dim)][:, :LEADING]
                own[at], rows, cells = splits[int(dim)].cells(lead, depth[at], width)
                order = np.argsort(rows, kind="stable")
                edges = np.searchsorted(rows[order], np.arange(len(at) + 1))
                for k, row in enumerate(at):
                    near[row] = cells[order[edges[k] : edges[k + 1]]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own.astype(np.int32)), pa.array(near, pa.list_(pa.int32()))], ["key", "embedding", "dim", "label", "copies", "cell", "near"])

    fields = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    schema = f"key binary, embedding {fields['embedding']}, dim int, label {fields['label']}, copies long, cell int, near array<int>"
    placed = map_arrow(nodes.join(sizes, ["label", "dim"]).select("key", "embedding", "dim", "label", "copies", "depth"), place, schema)
    placed = scratch.write(placed, "placed")
    cells = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(cells, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    near = cells.select("label", "dim", F.col("cell").alias("n_cell"), F.col("blocks").alias("n_blocks"))
    met = placed.withColumn("n_cell", F.explode("near")).join(near, ["label", "dim", "n_cell"])
    met = met.withColumn("n_block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    mine, other = F.struct("cell", "block"), F.struct(F.col("n_cell").alias("cell"), F.col("n_block").alias("block"))
    tiled = met.select(
        F.xxhash64("label", "dim", F.least(mine, other), F.greatest(mine, other)).alias("task"),
        F.when(mine <= other, 0).otherwise(1).alias("side"), (mine != other).alias("cross"), "key", "copies", "embedding",
    )
    found = scratch.write(map_groups(tiled, "task", _compare(turns, threshold), "key binary, links long, root binary"), "links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), scratch)
    known = nodes.select("key", "vec_id", "copies").join(counts, "key", "left").join(classes.withColumnRenamed("node", "key"), "key", "left")
    known = scratch.write(known.select("key", "vec_id", "copies", "links", F.coalesce("root", "key").alias("root")), "known")
    ids = known.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    known = known.join(ids, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = marked.select("vec_id", "key").join(known, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return scratch.keep(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
