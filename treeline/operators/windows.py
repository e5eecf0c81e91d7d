"""Window operators over ordered sites: runs, ranks, running gains, weighted quantiles, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import g_statistic


def runs(rows: DataFrame, group: list[str], order: str, state: str) -> DataFrame:
    """Run-length encoding: group, run (from 1), state, start, end, length."""
    w = Window.partitionBy(*group).orderBy(order)
    change = F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"), F.lit(1))
    marked = rows.withColumn("_change", F.when(F.row_number().over(w) == 1, 1).otherwise(change))
    numbered = marked.withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "run", state).agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length"))


def average_ranks(rows: DataFrame, group: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks by value from 1; ties share the mean of their places."""
    by_value, same = Window.partitionBy(*group).orderBy(value), Window.partitionBy(*group, value)
    return rows.withColumn(name, F.rank().over(by_value) + (F.count(F.lit(1)).over(same) - 1) / 2.0)


def holm(rows: DataFrame, group: list[str], p: str, key: str) -> DataFrame:
    """Step-down adjusted p: running maximum of min(1, (m - rank + 1) p)."""
    order = Window.partitionBy(*group).orderBy(p, key)
    raised = F.least(F.lit(1.0), (F.count(F.lit(1)).over(Window.partitionBy(*group)) - F.row_number().over(order) + 1) * F.col(p))
    return rows.withColumn("_raised", raised).withColumn("adjusted", F.max("_raised").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_raised")


def weighted_median(rows: DataFrame, group: list[str], position: str, weight: str) -> DataFrame:
    """First position at which the running weight is at least half of all."""
    running = F.sum(weight).over(Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy(*group))
    marked = rows.withColumn("_r", running).withColumn("_t", total)
    return marked.filter(2 * F.col("_r") >= F.col("_t")).groupBy(*group).agg(F.min(position).alias("median"))


def weighted_quantile(rows: DataFrame, group: list[str], position: str, weight: str, q: float) -> DataFrame:
    running = F.sum(weight).over(Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy(*group))
    return rows.withColumn("_r", running).withColumn("_t", total).filter(F.col("_r") >= q * F.col("_t")).groupBy(*group).agg(F.min(position).alias("quantile"))


def best_interval_gain(rows: DataFrame, group: list[str], order: str, gain: str, least: int) -> DataFrame:
    """Largest sum of gains over an interval of at least ``least`` positions: prefix sum less the smallest one before."""
    w = Window.partitionBy(*group).orderBy(order)
    prefix = rows.withColumn("_p", F.sum(gain).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = prefix.withColumn("_n", F.row_number().over(w)).withColumn("_m", F.min("_p").over(w.rowsBetween(Window.unboundedPreceding, -least)))
    gained = before.filter(F.col("_n") >= least).withColumn("_g", F.col("_p") - F.least(F.coalesce("_m", F.lit(0.0)), F.lit(0.0)))
    return gained.groupBy(*group).agg(F.max("_g").alias("gain"), F.max_by(order, F.struct(F.col("_g"), -F.col(order))).alias("end"))


def boundary_gap(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """boundary, gap of (state, boundary, cost) before and after each boundary: least staying cost or least changing cost, less the least of all."""
    f, b = forward.alias("f"), backward.alias("b")
    both = f.join(b, F.col("f.boundary") == F.col("b.boundary")).select(F.col("f.boundary").alias("boundary"), (F.col("f.state") == F.col("b.state")).alias("stay"), (F.col("f.cost") + F.col("b.cost")).alias("cost"))
    found = both.groupBy("boundary").agg(F.min(F.when(F.col("stay"), F.col("cost"))).alias("stay"), F.min(F.when(~F.col("stay"), F.col("cost"))).alias("change"))
    return found.withColumn("gap", F.col("change") - F.col("stay"))


def endpoint_interval(rows: DataFrame, group: list[str], order: str, score: str, tolerance: float) -> DataFrame:
    """The contiguous positions around the best one (first of equals) whose score is within a tolerance of it."""
    whole = Window.partitionBy(*group)
    best = rows.withColumn("_best", F.max(score).over(whole)).withColumn("_at", F.max_by(order, F.struct(F.col(score), -F.col(order))).over(whole))
    near = best.withColumn("near", (F.col(score) >= F.col("_best") - tolerance).cast("int"))
    islands = runs(near, [*group, "_at"], order, "near").filter("near = 1 AND _at BETWEEN start AND end")
    return islands.select(*group, F.col("_at").alias("best"), "start", "end")


def rolling_scan(events: DataFrame, width: int) -> DataFrame:
    """Counts of the three states in ``width`` events left and right of each boundary of a triplet, G statistic, and whether it is a local peak."""
    w = Window.partitionBy("a", "b", "c").orderBy("event")
    left, right = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
    count = lambda s, side: F.coalesce(F.sum((F.col("state") == s).cast("int")).over(side), F.lit(0))
    out = events.select("*", *[count(s, left).alias(f"l{s}") for s in range(3)], *[count(s, right).alias(f"r{s}") for s in range(3)])
    full = (F.col("l0") + F.col("l1") + F.col("l2") == width) & (F.col("r0") + F.col("r1") + F.col("r2") == width)
    out = out.withColumn("g", F.when(full, F.round(g_statistic([F.col(f"l{s}") for s in range(3)], [F.col(f"r{s}") for s in range(3)]), 9)))
    peak = (F.col("g") >= F.coalesce(F.lag("g").over(w), F.lit(0.0))) & (F.col("g") > F.coalesce(F.lead("g").over(w), F.lit(0.0)))
    return out.withColumn("peak", F.coalesce(peak, F.lit(False)))


def dominant(counts: list[Column]) -> Column:
    """Index of the strictly largest count, else -1."""
    top = F.greatest(*counts)
    alone = sum(((c == top).cast("int") for c in counts[1:]), (counts[0] == top).cast("int")) == 1
    which = F.lit(len(counts) - 1)
    for k in range(len(counts) - 2, -1, -1):
        which = F.when(counts[k] == top, k).otherwise(which)
    return F.when(alone, which).otherwise(-1)


def renumber(rows: DataFrame, group: list[str], order: str, number: str) -> DataFrame:
    """Reference numbers carried forward over insertions (null numbers), which are counted from 1 after each."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumn("carried", F.last(number, ignorenulls=True).over(w)).withColumn("_island", F.count(number).over(w))
    within = Window.partitionBy(*group, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return carried.withColumn("insertion", F.sum(F.col(number).isNull().cast("int")).over(within)).drop("_island")


def smooth(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Three-tap smoothing with weights 1, 2, 1; an end takes itself for its missing neighbour."""
    w = Window.partitionBy(*group).orderBy(order)
    v = F.col(value)
    return rows.withColumn("smoothed", (F.coalesce(F.lag(value).over(w), v) + 2 * v + F.coalesce(F.lead(value).over(w), v)) / 4)


def longest_run(rows: DataFrame, group: list[str], order: str, flag: str) -> DataFrame:
    """Longest run of true flags: group, start, length; the first of equals."""
    found = runs(rows, group, order, flag).filter(F.col(flag))
    best = found.groupBy(*group).agg(F.max(F.struct("length", (-F.col("start")).alias("s"))).alias("b"))
    return best.select(*group, (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"))


def cumulative_integral(rows: DataFrame, group: list[str], order: str, value: str, step: float) -> DataFrame:
    """Trapezoids summed along the order."""
    w = Window.partitionBy(*group).orderBy(order)
    part = F.coalesce((F.lag(value).over(w) + F.col(value)) / 2 * step, F.lit(0.0))
    return rows.withColumn("_part", part).withColumn("integral", F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_part")


def emission_accuracy(path: DataFrame, group: list[str], segment: str, state: str) -> DataFrame:
    """Share of a segment's positions in its most frequent state, with half a count for each of three states, within [0.34, 0.995]."""
    n = path.groupBy(*group, segment, state).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*group, segment).agg(F.max("n").alias("most"), F.sum("n").alias("total"))
    purity = (F.sum("most") + 0.5) / (F.sum("total") + 1.5)
    return best.groupBy(*group).agg(F.least(F.greatest(purity, F.lit(0.34)), F.lit(0.995)).alias("accuracy"))
