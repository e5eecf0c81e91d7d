"""Which triplets of taxa a scan looks at: all of them, or a cover of all pairs filled up to a budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the pair hash.
_FIRST, _SECOND = 0x9E3779B1, 0x85EBCA77
#: Pairs that are looked at together, and blocks of them that a task has at most.
_BLOCK, _BLOCKS = 1 << 16, 512


def third_of_pair(a: Column, b: Column, taxa: int) -> Column:
    """The taxon that joins the pair a < b in the cover: the pair's 32-bit hash over the taxa that are left."""
    word = lambda x, m: ((x.cast("long") + 1) * F.lit(m)) % F.lit(1 << 32)
    third = word(a, _FIRST).bitwiseXOR(word(b, _SECOND)) % F.lit(taxa - 2)
    third = F.when(third >= a, third + 1).otherwise(third)
    return F.when(third >= b, third + 1).otherwise(third)


def _thirds(a: np.ndarray, b: np.ndarray, taxa: int) -> np.ndarray:
    """``third_of_pair`` of arrays."""
    word = lambda x, m: ((x + 1) & 0xFFFFFFFF).astype(np.uint32) * np.uint32(m)
    third = (word(a, _FIRST) ^ word(b, _SECOND)).astype(np.int64) % (taxa - 2)
    third += third >= a
    third += third >= b
    return third


def pair_cover(spark: SparkSession, taxa: int) -> DataFrame:
    """rank, a, b, c of the triplets that pairs name, each once and without a shuffle: the first of a triplet's pairs that names it gives the row.

    Pairs are numbered row by row, a long row of the triangle with a short one, so all blocks of numbers have as much work.
    """
    rows = taxa // 2  # row p and row taxa - 2 - p have taxa pairs together
    blocks = -(-rows * taxa // _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        three = lambda m: m * (m - 1) * (m - 2) // 6
        for batch in batches:
            for block in batch.column("id").to_pylist():
                row, slot = np.divmod(np.arange(block * _BLOCK, min((block + 1) * _BLOCK, rows * taxa)), taxa)
                short = slot - (taxa - 1 - row)  # from 0 on in the short row
                own = (short < 0) | (row != taxa - 2 - row)
                p = np.where(short < 0, row, taxa - 2 - row)[own]
                q = p + 1 + np.where(short < 0, slot, short)[own]
                r = _thirds(p, q, taxa)
                a, c = np.minimum(p, r), np.maximum(q, r)
                b = p + q + r - a - c
                # the pairs of a triplet in order: a, b; a, c; b, c
                later = np.flatnonzero(r < q)
                other = _thirds(a[later], b[later], taxa) == c[later]
                other |= (r[later] < p[later]) & (_thirds(a[later], c[later], taxa) == b[later])
                first = np.ones(len(p), bool)
                first[later[other]] = False
                a, b, c = a[first], b[first], c[first]
                rank = three(taxa) - three(taxa - a) + (taxa - a - 1) * (taxa - a - 2) // 2 - (taxa - b) * (taxa - b - 1) // 2 + c - b - 1
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rank, a, b, c)], ["rank", "a", "b", "c"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-blocks // _BLOCKS))
    return spark.range(0, blocks, 1, tasks).mapInArrow(run, "rank long, a long, b long, c long")


def pairs_held(three: DataFrame, taxa: int) -> DataFrame:
    """p, q: the different pairs of the triplets a, b, c of a plan of ``taxa``.

    A plan has the triplet that a pair names, so there alone the pair is taken from, and nothing is shuffled.
    """
    sides = F.array(*[F.struct(F.col(x).alias("p"), F.col(y).alias("q"), F.col(z).alias("r")) for x, y, z in (("a", "b", "c"), ("a", "c", "b"), ("b", "c", "a"))])
    each = three.select(F.explode(sides).alias("s")).select("s.*")
    return each.filter(third_of_pair(F.col("p"), F.col("q"), taxa) == F.col("r")).select("p", "q")


def leading(rows: DataFrame, order: str, n: Column, most: int, width: int = 4096) -> DataFrame:
    """The first n rows by a whole number from 0 to ``most``: counts of bins first, so only the rows of one bin are ordered in a task."""
    binned = rows.withColumn("_bin", F.floor(F.col(order) / width))
    counts = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # one row for each of most / width bins
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).drop("_c")
    placed = binned.join(before, "_bin").withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy("_bin").orderBy(order)))
    return placed.filter(F.col("_k") <= n).drop("_bin", "_before", "_k")


def unranked(rows: DataFrame, taxa: int) -> DataFrame:
    """Adds a < b < c of each rank among the triplets of ``taxa``, in lexicographic order.

    Triplets begin at c0 = first rank of a, which a table of one row for each taxon gives; b follows from a square root.
    """
    n = F.lit(taxa).cast("long")
    total = taxa * (taxa - 1) * (taxa - 2) // 6
    left = lambda m: m * (m - 1) * (m - 2) / 6
    # the number of triplets from this one on bounds n - a by its cube root; the exact one is among its neighbours
    rest = F.lit(total) - F.col("rank")
    guess = F.floor(F.cbrt(6.0 * rest)).cast("long")
    m = F.array_min(F.filter(F.transform(F.sequence(F.greatest(guess - 1, F.lit(3)), guess + 4), lambda x: F.when(left(x) >= rest, x)), lambda x: x.isNotNull()))
    a = (n - m).cast("long")
    one = rows.withColumn("a", a).withColumn("_r", (F.col("rank") - (F.lit(total) - left(n - F.col("a")))).cast("long"))
    two = lambda m: m * (m - 1) / 2
    rest = two(n - F.col("a") - 1) - F.col("_r")
    guess = F.floor(F.sqrt(2.0 * rest)).cast("long")
    k = F.array_min(F.filter(F.transform(F.sequence(F.greatest(guess - 1, F.lit(2)), guess + 3), lambda x: F.when(two(x) >= rest, x)), lambda x: x.isNotNull()))
    both = one.withColumn("b", (n - k).cast("long"))
    c = F.col("b") + 1 + F.col("_r") - (two(n - F.col("a") - 1) - two(n - F.col("b")))
    return both.withColumn("c", c.cast("long")).drop("_r")


def plan(spark: SparkSession, taxa: int, most: int = 250_000) -> DataFrame:
    """rank, a, b, c of the triplets to scan, in a deterministic choice.

    All of them if they fit the budget. Else one triplet for every pair of taxa, whatever the budget, then
    evenly spaced ranks, then the lowest ranks that are left, up to the budget. Fewer than three taxa have no triplet.
    """
    total = taxa * (taxa - 1) * (taxa - 2) // 6
    most = max(1, min(total, most))
    if total <= most:
        return unranked(spark.range(total).select(F.col("id").alias("rank")), taxa)
    if taxa * (taxa - 1) // 2 >= 3 * most:  # a triplet holds three pairs, so the cover fills the budget
        return pair_cover(spark, taxa)
    cover = pair_cover(spark, taxa).select("rank")
    size = cover.agg(F.count(F.lit(1)).alias("size"))
    target = F.least(F.lit(total), F.greatest(F.lit(most), F.col("size")))
    bound = max(most, taxa * (taxa - 1) // 2)
    spaced = spark.range(bound).crossJoin(F.broadcast(size)).filter(F.col("id") < target)
    rank = F.least(F.lit(total - 1), F.floor((F.col("id") + 0.5) * total / target))
    spaced = spaced.select(rank.cast("long").alias("rank"), "id", "size", (target - F.col("size")).alias("room")).groupBy("rank").agg(F.min("id").alias("id"), F.max("room").alias("room"))
    spaced = leading(spaced.join(cover, "rank", "left_anti"), "id", F.col("room"), bound).select("rank")
    held = cover.unionByName(spaced)
    size = size.crossJoin(held.agg(F.count(F.lit(1)).alias("held")))
    low = spark.range(bound).crossJoin(F.broadcast(size)).filter(F.col("id") < target).select(F.col("id").alias("rank"), (target - F.col("held")).alias("room"))
    low = leading(low.join(held, "rank", "left_anti"), "rank", F.col("room"), bound).select("rank")
    return unranked(held.unionByName(low), taxa)
