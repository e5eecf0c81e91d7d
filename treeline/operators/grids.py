"""Parameter grids: cross joins of transformed axes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Offset of the transformed axis: 10^x - 0.05 reaches zero at x = log10(0.05).
OFFSET = 0.05
LOW, STEP = -1.3010299956639813, 0.6505149978319906


def rate(x: Column) -> Column:
    """Grid coordinate to rate."""
    return F.greatest(F.pow(F.lit(10.0), x) - OFFSET, F.lit(0.0))


def axis(spark: SparkSession, n: int, name: str, low: float = LOW, step: float = STEP) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(f"{name}_idx"), rate(F.lit(low) + F.col("id") * step).alias(name))


def site_rates(n: int = 20) -> list[float]:
    """Rates of the axes of a site-selection grid (fixed transform: 0.002 to 34.5 at n = 20, with a step near 1)."""
    return [10 ** ((i + 1) / 6.578947368421053 - 1.502) - 0.0423174293933042 for i in range(n)]


def transformed_rates(low: float, high: float, below_one: int) -> list[float]:
    """Rates of equal steps of log10(rate + 0.05) from low, below_one of them up to 1, and on to high at most."""
    start, stop = math.log10(low + OFFSET), math.log10(high + OFFSET)
    step = (math.log10(1 + OFFSET) - start) / below_one
    return [max(0.0, 10 ** (start + step * i) - OFFSET) for i in range(math.floor((stop - start) / step + 1e-12) + 1)]


def selection_grid(spark: SparkSession, n: int) -> DataFrame:
    """n x n grid of synonymous and nonsynonymous rates, alpha-major."""
    a, b = axis(spark, n, "alpha"), axis(spark, n, "beta")
    return a.crossJoin(F.broadcast(b)).select((F.col("alpha_idx") * n + F.col("beta_idx")).alias("category"), "alpha_idx", "beta_idx", "alpha", "beta")


def product_grid(spark: SparkSession, axes: dict[str, list[float]]) -> DataFrame:
    """The product of literal axes in order; category counts with the last axis fastest."""
    out = None
    for name, values in axes.items():
        one = spark.range(len(values)).select(F.col("id").cast("int").alias(f"{name}_idx"), F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("id") + 1).cast("int")).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    category = F.lit(0)
    for name, values in axes.items():
        category = category * len(values) + F.col(f"{name}_idx")
    return out.select(category.cast("int").alias("category"), *out.columns)


def differential_grid(spark: SparkSession, alphas: list[float], omegas: list[float], background: list[float] | None = None) -> DataFrame:
    axes = {"alpha": alphas, "omega1": omegas, "omega2": omegas}
    return product_grid(spark, axes | ({"omega_bg": background} if background else {}))


def episodic_grid(spark: SparkSession, alphas: list[float], low: list[float], high: list[float]) -> DataFrame:
    """alpha x omega1 x omega2 with omega1 at most 1."""
    return product_grid(spark, {"alpha": alphas, "omega1": [w for w in low if w <= 1], "omega2": high})


def shift_grid(base: DataFrame, intensities: list[float]) -> DataFrame:
    """Every baseline category with no shift (k_idx 0) and with each intensity."""
    k = F.explode(F.array(*[F.struct(F.lit(i).alias("k_idx"), F.lit(v).alias("k")) for i, v in enumerate([1.0, *map(float, intensities)])]))
    return base.withColumn("_k", k).select(*base.columns, "_k.k_idx", "_k.k")


def quadrature(n: int) -> tuple[list[float], list[float]]:
    """Gauss-Legendre nodes and weights on [0, 1]; weights sum to 1."""
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(n)
    return [(float(v) + 1) / 2 for v in x], [float(v) / 2 for v in w]


def quadrature_table(spark: SparkSession, n: int) -> DataFrame:
    x, w = quadrature(n)
    at = (F.col("id") + 1).cast("int")
    return spark.range(n).select(F.col("id").cast("int").alias("node"), F.element_at(F.array(*map(F.lit, x)), at).alias("x"), F.element_at(F.array(*map(F.lit, w)), at).alias("w"))


def log_spaced(low: float, high: float, n: int) -> list[float]:
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)] if n > 1 else [low]


def expected_resets(low: float, high: float, n: int) -> list[float]:
    """Log-spaced expected numbers of switches."""
    return log_spaced(low, high, n)
