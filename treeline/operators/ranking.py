"""Top-k selections, dedup by key, and set comparisons of splits and clades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first in an order; one bounded heap for each task and one to merge them."""
    return rows.orderBy(*order).limit(k)


def top_k_each(rows: DataFrame, group: list[str], k: int, *order: Column) -> DataFrame:
    """The k first of each group with their rank; Spark limits groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def top_mass(rows: DataFrame, group: list[str], category: str, mass: str, target: float, most: int) -> DataFrame:
    """Categories by falling mass until the target or the cap, renormalised; ties by category."""
    order = Window.partitionBy(*group).orderBy(F.desc(mass), category)
    running = rows.withColumn("rank", F.row_number().over(order)).withColumn("_cum", F.sum(mass).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = running.filter((F.col("_cum") - F.col(mass) < target) & (F.col("rank") <= most))
    return kept.withColumn("share", F.col(mass) / F.sum(mass).over(Window.partitionBy(*group))).drop("_cum")


def diverse(rows: DataFrame, group: list[str], k: int, *order: Column) -> DataFrame:
    """Seven tenths of k from the top, the rest evenly spaced over the whole order."""
    best = -(-7 * k // 10)
    spaced = k - best
    w = Window.partitionBy(*group)
    numbered = rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    at = F.transform(F.sequence(F.lit(0), F.lit(max(spaced - 1, 0))), lambda i: F.floor((i + 0.5) * F.col("_n") / max(spaced, 1)).cast("int") + 1)
    picked = F.col("rank") <= best
    if spaced:
        picked = picked | F.array_contains(at, F.col("rank"))
    return numbered.filter(picked).drop("_n")


def evenly_spaced(spark: SparkSession, n: int, k: int) -> DataFrame:
    """i, index = floor((i + 0.5) n / k)."""
    return spark.range(k).select(F.col("id").cast("int").alias("i"), F.floor((F.col("id") + 0.5) * n / k).cast("int").alias("index"))


def round_robin(rows: DataFrame, key: list[str], width: int, orders: list[tuple[Column, list[Column]]]) -> DataFrame:
    """``width`` rows taken in turn from several rankings, each of the rows that its condition lets in; a row counts once.

    Rows are told apart by ``key``. After as many turns as ``width`` that many rows are chosen, so only the first
    ``width`` of each ranking matter; each is one bounded heap for each task.
    """
    turns = []
    for n, (condition, order) in enumerate(orders):
        first = rows.filter(condition).orderBy(*order).limit(width)
        turns.append(first.withColumn("_turn", F.row_number().over(Window.orderBy(*order))).withColumn("_order", F.lit(n)))
    every = turns[0]
    for turn in turns[1:]:
        every = every.unionByName(turn)
    once = every.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct("_turn", "_order")).alias("r"), F.min(F.struct("_turn", "_order")).alias("_at"))
    return once.orderBy("_at").limit(width).select("r.*")


def best_of(rows: DataFrame, key: list[str], score: Column, tie: str) -> DataFrame:
    """The row of each key with the least score, ties by ``tie``; one aggregate without a sort."""
    value = F.struct(*rows.columns)
    return rows.groupBy(*key).agg(F.min_by(value, F.struct(score, F.col(tie))).alias("r")).select("r.*")


def splits(clades: DataFrame) -> DataFrame:
    """tree_id, split (smaller side, sorted; of two equal ones the first), size, for clades that divide the tips non-trivially."""
    everything = clades.groupBy("tree_id").agg(F.sort_array(F.collect_set("tip")).alias("all"))
    side = clades.groupBy("tree_id", "clade").agg(F.sort_array(F.collect_set("tip")).alias("side")).join(F.broadcast(everything), "tree_id")
    other = F.array_except("all", "side")
    text, rest = F.array_join("side", ","), F.array_join(F.sort_array(other), ",")
    smaller = F.when(F.size("side") < F.size(other), text).when(F.size("side") > F.size(other), rest).otherwise(F.least(text, rest))
    sized = side.filter((F.size("side") >= 2) & (F.size(other) >= 2))
    return sized.select("tree_id", smaller.alias("split"), F.least(F.size("side"), F.size(other)).alias("size")).distinct()


def signature(split_rows: DataFrame) -> DataFrame:
    """tree_id, signature: sorted splits as one text."""
    return split_rows.groupBy("tree_id").agg(F.array_join(F.sort_array(F.collect_set("split")), ";").alias("signature"))


def split_distance(split_rows: DataFrame, one: str, two: str) -> DataFrame:
    """only_a, only_b, distance (their sum), half, normalised by all splits."""
    a = split_rows.filter(F.col("tree_id") == one).select("split")
    b = split_rows.filter(F.col("tree_id") == two).select("split")
    marked = a.withColumn("x", F.lit(1)).unionByName(b.withColumn("x", F.lit(2))).groupBy("split").agg(F.sum("x").alias("x"))
    n = marked.agg(*[F.coalesce(F.sum((F.col("x") == k).cast("long")), F.lit(0)).alias(c) for k, c in ((1, "only_a"), (2, "only_b"), (3, "both"))])
    distance = F.col("only_a") + F.col("only_b")
    return n.select("only_a", "only_b", distance.alias("distance"), (distance / 2.0).alias("half"), F.coalesce(distance / F.nullif(distance + 2 * F.col("both"), F.lit(0)), F.lit(0.0)).alias("normalised"))


def resolved(split_rows: DataFrame, taxa: int) -> DataFrame:
    """tree_id, splits, whether an unrooted tree of so many taxa is fully resolved."""
    n = split_rows.groupBy("tree_id").agg(F.countDistinct("split").alias("splits"))
    return n.withColumn("resolved", F.col("splits") == taxa - 3)


def rooted_clades(clades: DataFrame) -> DataFrame:
    return clades.groupBy("tree_id", "clade").agg(F.array_join(F.sort_array(F.collect_set("tip")), ",").alias("tips"), F.countDistinct("tip").alias("size")).filter("size > 1")


def union_first(windows: DataFrame, order: str) -> DataFrame:
    """One window for each range, the first by ``order``."""
    return best_of(windows, ["start", "end"], F.col(order), "label")
