"""Signals side by side: calls, agreement, correlation, confusion, ranking quality and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import average_ranks

#: Rules of metric name -> (threshold, direction), in order; the first that matches counts.
THRESHOLDS = (
    (r"(?i)p.?value|^p$|fdr", 0.05, "at-most"),
    (r"(?i)post|prob", 0.95, "at-least"),
    (r"(?i)bayes", 10.0, "at-least"),
    (r"(?i)omega|ratio", 1.0, "at-least"),
)


def finite(rows: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def with_thresholds(rows: DataFrame) -> DataFrame:
    """threshold and direction of each metric by the first rule that matches, else 0 and at-least."""
    threshold, direction = F.lit(0.0), F.lit("at-least")
    for pattern, t, d in reversed(THRESHOLDS):
        hit = F.col("metric").rlike(pattern)
        threshold, direction = F.when(hit, t).otherwise(threshold), F.when(hit, d).otherwise(direction)
    return rows.withColumn("threshold", threshold).withColumn("direction", direction)


def with_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Thresholds replaced by an override for the node (source and method), else one for the method."""
    node = overrides.filter("source IS NOT NULL").select("source", "method", F.col("threshold").alias("t1"))
    method = overrides.filter("source IS NULL").select("method", F.col("threshold").alias("t2"))
    joined = rows.join(F.broadcast(node), ["source", "method"], "left").join(F.broadcast(method), "method", "left")
    return joined.withColumn("threshold", F.coalesce("t1", "t2", "threshold")).drop("t1", "t2")


def passes(value: Column, threshold: Column, direction: Column) -> Column:
    """Inclusive both ways."""
    return F.when(direction == "at-most", value <= threshold).otherwise(value >= threshold)


def suggested_threshold(kind: Column) -> tuple[Column, Column]:
    value = F.when(kind == "p", 0.05).when(kind == "probability", 0.95).when(kind == "binary", 0.5).when(kind == "omega", 1.0).otherwise(0.0)
    return value, F.when(kind == "p", "at-most").otherwise("at-least")


def preferred_signal(rows: DataFrame, preference: list[str]) -> DataFrame:
    """One metric for each dataset, source and method: the earliest in the list, else the first by name."""
    rank = F.lit(len(preference))
    for k in range(len(preference) - 1, -1, -1):
        rank = F.when(F.col("metric") == preference[k], k).otherwise(rank)
    metrics = rows.groupBy("dataset", "source", "method").agg(F.min_by("metric", F.struct(rank, F.col("metric"))).alias("metric"))
    return metrics


def pair_join(rows: DataFrame) -> DataFrame:
    """Pairs of metrics of one dataset on their common keys: dataset, a, b, key, x, y."""
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.dataset") == F.col("b.dataset")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.metric") < F.col("b.metric"))
    return a.join(b, on).select(F.col("a.dataset").alias("dataset"), F.col("a.metric").alias("a"), F.col("b.metric").alias("b"), F.col("a.key").alias("key"), F.col("a.value").alias("x"), F.col("b.value").alias("y"))


def pearson(x: str, y: str) -> Column:
    """Aggregate: null for fewer than two pairs or no variance. Merged variances of equal values can be above 0, so the values' range is asked."""
    n, vx, vy = F.count(F.lit(1)), F.var_pop(x), F.var_pop(y)
    ok = (n >= 2) & (vx > 0) & (vy > 0) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(ok, F.try_divide(F.covar_pop(x, y), F.sqrt(vx * vy)))


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("dataset", "a", "b").agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("pearson"))


def spearman(pairs: DataFrame, group: list[str]) -> DataFrame:
    ranked = average_ranks(average_ranks(pairs, group, "x", "rx"), group, "y", "ry")
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), pearson("rx", "ry").alias("spearman"))


def agreement(calls: DataFrame, group: list[str], when_none: float | None = 1.0) -> DataFrame:
    """Jaccard index of two boolean calls (x, y) and the share of equal ones."""
    both, either = F.sum((F.col("x") & F.col("y")).cast("long")), F.sum((F.col("x") | F.col("y")).cast("long"))
    none = F.lit(when_none).cast("double")
    return calls.groupBy(*group).agg(F.when(either > 0, F.try_divide(both, either)).otherwise(none).alias("jaccard"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("overall"))


def confusion(rows: DataFrame, group: list[str], label: Column, call: Column) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, specificity, accuracy; 0 where a denominator is empty."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = rows.groupBy(*group).agg(n(label & call).alias("tp"), n(~label & call).alias("fp"), n(label & ~call).alias("fn"), n(~label & ~call).alias("tn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select("*", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(tn, tn + fp).alias("specificity"), rate(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def roc_auc(rows: DataFrame, group: list[str], label: str, score: str) -> DataFrame:
    """Mann-Whitney with averaged ties, by one row for each different score; null without both classes.

    Scores are counted before they are ordered, so the running sum sees different scores only.
    """
    by_score = rows.groupBy(*group, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = by_score.withColumn("won", F.col("p") * (2 * below + F.col("q")))
    out = won.groupBy(*group).agg(F.sum("won").alias("w"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    return out.select(*group, "positives", "negatives", F.try_divide(F.col("w"), 2 * F.col("positives") * F.col("negatives")).alias("auc"))


def average_precision(rows: DataFrame, group: list[str], label: str, score: str, tie: str) -> DataFrame:
    """Mean precision at the positives by falling score, ties by ``tie``."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    at = F.sum(label).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.row_number().over(order)
    return rows.withColumn("_at", at).filter(F.col(label) == 1).groupBy(*group).agg(F.avg("_at").alias("average_precision"))


def binary_metrics(rows: DataFrame, group: list[str], label: str, score: str, threshold: float) -> DataFrame:
    """Confusion counts, precision (1 without calls), recall and Brier score."""
    call, truth = F.col(score) >= threshold, F.col(label) == 1
    n = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy(*group).agg(n(truth & call).alias("tp"), n(~truth & call).alias("fp"), n(truth & ~call).alias("fn"), F.avg((F.col(score) - F.col(label)) ** 2).alias("brier"))
    return out.select("*", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def wide(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each dataset and key with a column for each metric: a full outer join as one aggregate."""
    return rows.groupBy("dataset", "key").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics])


def catalog(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "method", "metric").agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("dataset").alias("datasets"), F.min("value").alias("least"), F.max("value").alias("most"))


def scopes(rows: DataFrame) -> DataFrame:
    """Counts by dataset and source, and by dataset over all sources."""
    return rows.rollup("dataset", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).filter("dataset IS NOT NULL").withColumn("source", F.coalesce("source", F.lit("all")))


def replicate_summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    q = lambda p: F.expr(f"percentile({value}, {p})")
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), q(0.5).alias("median"), q(0.9).alias("q90"), q(0.95).alias("q95"))
