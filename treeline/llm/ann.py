"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long hash string, one bit for each random hyperplane, and keeps the
strings in a sorted array. A query descends in every tree to its longest matching prefix. From there
all trees ascend together, one bit at a time, until the rows that share the prefix are enough
candidates; all of them, however many, are compared by exact cosine.

Rows are dealt by hash to shards whose size is bounded, each with a forest of its own; the stated
queries go to every shard in turn. Of rows with equal vectors, which tie, only the smallest vec_ids
can be an answer, so k + 1 of them stand for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .vectors import matrix, usable

TREES, BITS = 48, 64
#: Rows in a shard, on average, and where trees stop ascending: when the rows under their prefixes, counted
#: once for each tree, reach this share of the shard. Vectors without structure need so many for a recall above
#: 0.9 (0.97 measured on 10,256 such vectors of 64 dimensions); clustered vectors do with far fewer.
SHARD_ROWS, CANDIDATES = 50_000, 0.5
#: Tables of less than a shard for each partition are dealt more finely, to shards of so many rows at least.
LEAST_ROWS = 5_000


class Forest:
    """Sorted hash strings of the rows of x, one array for each tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((trees, x.shape[1], BITS))
        self.strings, self.rows = [], []
        for tree in range(trees):
            s = self.hash(x, tree)
            order = np.argsort(s, kind="stable")
            self.strings.append(s[order])
            self.rows.append(order)

    def hash(self, x: np.ndarray, tree: int) -> np.ndarray:
        bits = (x @ self.planes[tree]) > 0
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the rows that share its prefix at the longest length at which all trees together have ``least``."""
        trees = len(self.strings)
        own = np.stack([self.hash(queries, t) for t in range(trees)])
        lo, hi = np.zeros((BITS + 1, trees, len(queries)), np.int32), np.zeros((BITS + 1, trees, len(queries)), np.int32)
        for t, strings in enumerate(self.strings):
            for length in range(BITS + 1):
                tail = np.uint64((1 << (BITS - length)) - 1)
                lo[length, t] = np.searchsorted(strings, own[t] & ~tail, "left")
                hi[length, t] = np.searchsorted(strings, own[t] | tail, "right")
        enough = (hi - lo).sum(axis=1) >= least  # [length, query]; true at length 0 or never
        length = np.where(enough.any(axis=0), BITS - np.argmax(enough[::-1], axis=0), 0)
        for k, n in enumerate(length):
            yield np.unique(np.concatenate([self.rows[t][lo[n, t, k] : hi[n, t, k]] for t in range(trees)]))


def _search(k: int, share: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard after the other: its rows first, then its queries."""
        shard, held, forest = None, [], None
        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            asks = np.asarray(batch.column(1))
            edges = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1), len(shards)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if shards[a] != shard:
                    shard, held, forest = shards[a], [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(part)
                elif held:
                    if forest is None:
                        table = pa.Table.from_batches(held)
                        x = matrix(table.column("embedding"))
                        forest, ids, norms = Forest(x), table.column("vec_id").to_numpy(), np.sqrt(np.einsum("ij,ij->i", x, x))
                        same = np.array(table.column("key").to_pylist(), dtype=object)
                    yield from _answers(part, forest, x, norms, ids, same, k, max(k + 1, int(share * len(ids))))

    return search


def _answers(part: pa.RecordBatch, forest: Forest, x: np.ndarray, norms: np.ndarray, ids: np.ndarray, same: np.ndarray, k: int, least: int) -> Iterator[pa.RecordBatch]:
    names = part.schema.names
    queries = matrix(part.column(names.index("embedding")))
    query_ids, keys = part.column(names.index("vec_id")).to_numpy(), part.column(names.index("key")).to_pylist()
    for lo in range(0, len(queries), 256):
        out: tuple[list, ...] = ([], [], [], [])
        for n, near in enumerate(forest.candidates(queries[lo : lo + 256], least), lo):
            q = queries[n]
            score = np.einsum("ij,j->i", x[near], q) / (norms[near] * np.sqrt(q @ q))
            score[(ids[near] == query_ids[n]) & (same[near] == keys[n])] = -np.inf  # the query's own row
            order = np.lexsort((ids[near], -score))[:k]
            for at in order:
                if score[at] > -np.inf:
                    for column, value in zip(out, (int(query_ids[n]), keys[n], int(ids[near[at]]), float(score[at])), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], ["query_id", "key", "vec_id", "score"])


def nearest(rows: DataFrame, is_query, k: int = 5, share: float = CANDIDATES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that ``is_query`` (a condition on rows) holds for.

    Nearest first by cosine, ties to the smaller vec_id; fewer if there are fewer. Candidates are all
    rows but the query's own; vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows without vec_id; vectors of different dimensions don't meet. Repeated
    rows (equal vec_id and vector) are one row; different vectors of one vec_id are queries of their
    own, each with ranks from 1. An empty table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    fine = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    whole = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))
    key = F.unhex(F.md5(F.concat_ws(",", whole.cast("array<string>")).cast("binary")))
    vectors = fine.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", key.alias("key"), is_query.alias("asks")).dropDuplicates(["vec_id", "key"])
    vectors = scratch.write(vectors.withColumn("dim", F.size("embedding")), "vectors")
    first = Window.partitionBy("key").orderBy("vec_id")
    data = vectors.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    finer = lambda n: min(partitions(spark), n // LEAST_ROWS)
    sizes = {r.dim: max(1, -(-r["count"] // shard_rows), finer(r["count"])) for r in vectors.groupBy("dim").count().collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("dim"))
    place = lambda n: F.col("dim").cast("long") * (1 << 32) + n
    data = data.select(place(F.pmod(F.xxhash64("key"), shards)).alias("shard"), F.lit(False).alias("asks"), "vec_id", "embedding", "key")
    asked = vectors.filter("asks").withColumn("s", F.explode(F.sequence(F.lit(0), shards - 1))).select(place(F.col("s")).alias("shard"), "asks", "vec_id", "embedding", "key")
    dealt = data.unionByName(asked).repartition(max(1, sum(sizes.values())), "shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(_search(k, share), "query_id long, key binary, vec_id long, score double")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return scratch.keep(best.select("query_id", "rank", "vec_id", "score"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
