"""Mixtures of ratios along a branch, as rows: one for each operator and ratio, ready to be joined with models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .grids import product_grid, quadrature_table

#: Coarse candidates of the global gamma fit, by preset.
CANDIDATES = {
    "quick": {"omega_mean": [0.06, 0.25, 1, 4.5], "omega_shape": [0.08, 0.32, 1.3, 5.2], "alpha_shape": [0.12, 0.5, 2, 8]},
    "thorough": {
        "omega_mean": [0.08, 0.13, 0.21, 0.34, 0.55, 0.8, 1.1, 1.55, 2.3, 3.6, 6],
        "omega_shape": [0.12, 0.2, 0.32, 0.5, 0.8, 1.25, 2, 3.2, 5, 8],
        "alpha_shape": [0.16, 0.25, 0.4, 0.63, 1, 1.6, 2.5, 4, 6.3, 10],
    },
}
#: Bounds within which candidates are refined.
BOUNDS = {"omega_mean": (0.03, 12.0), "omega_shape": (0.08, 12.0), "alpha_shape": (0.1, 16.0)}


@pandas_udf(T.ArrayType(T.DoubleType()))
def slices(mean: pd.Series, shape: pd.Series, n: pd.Series) -> pd.Series:
    """n equally likely rates of a gamma distribution; nulls give null."""
    from ..kernels.inference import gamma_slices

    return pd.Series([None if pd.isna(m) or pd.isna(s) else gamma_slices(int(k), float(s), float(m)) for m, s, k in zip(mean, shape, n, strict=True)], dtype=object)


@pandas_udf(T.ArrayType(T.StructType([T.StructField("omega", T.DoubleType()), T.StructField("weight", T.DoubleType())])))
def split(mean: pd.Series, shape: pd.Series, n: pd.Series) -> pd.Series:
    """Rates with weights, those above 1 apart from those below; nulls give null."""
    from ..kernels.inference import split_slices

    return pd.Series([None if pd.isna(m) or pd.isna(s) else [{"omega": r, "weight": w} for r, w in split_slices(int(k), float(s), float(m))] for m, s, k in zip(mean, shape, n, strict=True)], dtype=object)


def draft_rule(spark: SparkSession, points: int) -> DataFrame:
    """Evenly spaced nodes of equal weight, ends included; the likelihood's logarithm is averaged over them."""
    return spark.range(points).select(F.col("id").cast("int").alias("node"), (F.col("id") / (points - 1)).alias("x"), F.lit(1.0 / points).alias("w"))


def episodic_operators(grid: DataFrame, points: int, even: bool = False) -> DataFrame:
    """category, node, scale, collapse, omega, weight: two ratios mixed at every node of the rule; weight 0 is left out and equal ratios are one."""
    rule = draft_rule(grid.sparkSession, points) if even else quadrature_table(grid.sparkSession, points)
    parts = F.array(F.struct(F.col("omega1").alias("omega"), F.col("x").alias("weight")), F.struct(F.col("omega2").alias("omega"), (1 - F.col("x")).alias("weight")))
    one = F.array(F.struct(F.col("omega1").alias("omega"), F.lit(1.0).alias("weight")))
    mixed = F.when(F.col("omega1") == F.col("omega2"), one).otherwise(F.filter(parts, lambda p: p["weight"] > 0))
    return grid.crossJoin(F.broadcast(rule)).select("category", "node", F.col("alpha").alias("scale"), F.col("w").alias("collapse"), F.inline(mixed))


def gamma_operators(grid: DataFrame, n: int) -> DataFrame:
    """category, scale, omega, weight of grid rows (category, alpha, mean, shape, capped): slices of a gamma, capped ones at 1, equal ratios added up."""
    pairs = grid.select("mean", "shape").distinct().withColumn("omega", F.explode(slices("mean", "shape", F.lit(n))))
    cut = F.when(F.col("capped"), F.least(F.col("omega"), F.lit(1.0))).otherwise(F.col("omega"))
    joined = grid.join(pairs, ["mean", "shape"]).withColumn("omega", cut)
    return joined.groupBy("category", F.col("alpha").alias("scale"), "omega").agg((F.count(F.lit(1)) / n).alias("weight"))


def gamma_candidates(spark: SparkSession, preset: str = "quick") -> DataFrame:
    """category and the three parameters of the coarse candidates."""
    return product_grid(spark, CANDIDATES[preset]).select("category", *BOUNDS)


def refined_candidates(best: DataFrame, radius: float) -> DataFrame:
    """The 27 neighbours (fewer at a bound) of each row's parameters, a factor exp(radius) apart, within bounds."""

    def around(name: str) -> Column:
        low, high = BOUNDS[name]
        near = [F.least(F.greatest(F.col(name) * F.exp(F.lit(k * radius)), F.lit(low)), F.lit(high)) for k in (-1, 0, 1)]
        return F.explode(F.array_distinct(F.array(*[F.round(v, 12) for v in near])))

    out = best.select(*BOUNDS)
    for name in BOUNDS:
        out = out.withColumn(name, around(name))
    return out.distinct()


def candidate_categories(candidates: DataFrame, alphas: int, omegas: int) -> DataFrame:
    """category, slice, alpha, omega_mean, omega_shape, positive: each candidate at every slice of its synonymous rates; positive is its mass above 1."""
    by_shape = candidates.select("alpha_shape").distinct().select("alpha_shape", F.posexplode(slices(F.lit(1.0), "alpha_shape", F.lit(alphas))).alias("slice", "alpha"))
    above = F.aggregate(F.filter("s", lambda p: p["omega"] > 1), F.lit(0.0), lambda total, p: total + p["weight"])
    masses = candidates.select("omega_mean", "omega_shape").distinct().withColumn("s", split("omega_mean", "omega_shape", F.lit(omegas))).select("omega_mean", "omega_shape", above.alias("positive"))
    return candidates.join(F.broadcast(by_shape), "alpha_shape").join(F.broadcast(masses), ["omega_mean", "omega_shape"]).select("category", "slice", "alpha", "omega_mean", "omega_shape", "positive")
