"""Likelihoods over a grid of categories: normalising, EM, posteriors and their tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import kept


def max_shift(lik: DataFrame) -> DataFrame:
    """site, category, l = exp(logl - site maximum)."""
    top = F.max("logl").over(Window.partitionBy("site"))
    return lik.select("site", "category", F.exp(F.col("logl") - top).alias("l"))


def normalise(shifted: DataFrame) -> DataFrame:
    return shifted.withColumn("l", F.col("l") / F.sum("l").over(Window.partitionBy("site")))


def normalise_packed(sites: DataFrame) -> DataFrame:
    """site, l of a site's categories in one array (site, logl): as max_shift and normalise, without a shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                logl = np.stack(frame["logl"].to_numpy())
                l = np.exp(logl - logl.max(1, keepdims=True))  # noqa: E741
                yield pd.DataFrame({"site": frame["site"], "l": list(l / l.sum(1, keepdims=True))})

    kind = dict(sites.dtypes)["site"]
    return sites.select("site", "logl").mapInPandas(run, f"site {kind}, l array<double>")


def em_packed(packed: DataFrame, steps: int, concentration: float = 0.5, weight: str | None = None) -> DataFrame:
    """category, theta as ``em`` gives them, of arrays (site, l) of equal length; ``weight`` says for how many sites a row stands.

    The arrays are written into the shared folder once; a step is one pass over them, and the driver holds a number for each category.
    """
    parts = max(1, packed.sparkSession.sparkContext.defaultParallelism)
    held = kept(packed.select("l", (F.col(weight) if weight else F.lit(1)).alias("n")).repartition(parts))
    theta = em_held(held, steps, concentration).tolist()
    return packed.sparkSession.createDataFrame(list(enumerate(theta)), "category int, theta double")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """[row, category] of arrays of equal length."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def em_held(held: DataFrame, steps: int, concentration: float = 0.5) -> np.ndarray:
    """Weights of the categories as ``em_packed`` gives them, of rows (l, n) that are written already."""
    first = held.select(F.size("l").alias("n")).first()
    n = first["n"] if first else 0
    theta = np.full(n, 1.0 / max(n, 1))
    for _ in range(steps if n else 0):
        now = theta

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n)
            for batch in batches:
                if batch.num_rows:
                    w = _matrix(batch, "l") * now  # noqa: B023
                    total += (batch.column("n").to_numpy(zero_copy_only=False) / w.sum(1)) @ w
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total)], ["category", "n"])

        counts = np.zeros(n)
        for r in held.mapInArrow(expect, "category int, n double").groupBy("category").agg(F.sum("n").alias("n")).collect():
            counts[r["category"]] = r["n"]
        theta = (counts + concentration) / (counts.sum() + concentration * n)
    return theta


def selection_held(held: DataFrame, theta: np.ndarray, alpha: np.ndarray, beta: np.ndarray, threshold: float = 0.9) -> DataFrame:
    """The columns of ``held`` but l, and those of ``selection_table``: the posterior of a row's categories never leaves its row."""
    rest = [c for c in held.columns if c != "l"]
    names = ["p_positive", "p_purifying", "mean_alpha", "mean_beta"]
    value = np.stack([beta > alpha, beta < alpha, alpha, beta], 1).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = _matrix(batch, "l") * theta
                found = (w / w.sum(1, keepdims=True)) @ value
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *[pa.array(x) for x in found.T]], [*rest, *names])

    kinds = dict(held.dtypes)
    out = held.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in rest], *[f"{c} double" for c in names]]))
    return out.withColumn("selection", _call(threshold))


def _call(threshold: float) -> Column:
    return F.when(F.col("p_positive") > threshold, "positive").when(F.col("p_purifying") > threshold, "purifying").otherwise("neutral")


def posterior_packed(packed: DataFrame, theta: DataFrame) -> DataFrame:
    """site, category, mass as ``posterior`` gives them: a site's categories never leave its row before they are exploded."""
    one = theta.agg(F.transform(F.sort_array(F.collect_list(F.struct("category", "theta"))), lambda x: x["theta"]).alias("theta"))
    weighted = packed.crossJoin(F.broadcast(one)).select("site", F.zip_with("l", "theta", lambda l, t: l * t).alias("w"))  # noqa: E741
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return weighted.select("site", total.alias("_t"), F.posexplode("w").alias("category", "one")).select("site", "category", (F.col("one") / F.col("_t")).alias("mass"))


def sparsify(normal: DataFrame, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """(cells at or above a cutoff, sites that lost all of theirs)."""
    kept = normal.filter(F.col("l") >= cutoff)
    return kept, normal.select("site").distinct().join(kept.select("site"), "site", "left_anti")


def em_step(normal: DataFrame, theta: DataFrame, concentration: float) -> DataFrame:
    """category, theta after one step: (c + expected count) / (sites + c categories).

    theta has one row for each category, a number that the grid bounds, so it is broadcast.
    """
    weighted = normal.join(F.broadcast(theta), "category").withColumn("w", F.col("l") * F.col("theta"))
    share = weighted.withColumn("r", F.col("w") / F.sum("w").over(Window.partitionBy("site")))
    counts = share.groupBy("category").agg(F.sum("r").alias("n"))
    everything = Window.partitionBy()
    return counts.withColumn("theta", (F.col("n") + concentration) / (F.sum("n").over(everything) + concentration * F.count(F.lit(1)).over(everything))).select("category", "theta")


def em(normal: DataFrame, steps: int, concentration: float = 0.5, tolerance: float | None = None) -> DataFrame:
    """theta after so many steps; with a tolerance it stops once no weight moves more.

    With a tolerance each step is one action, whose rows (one for each category of the grid) the driver compares with the last.
    """
    categories = normal.select("category").distinct()
    theta = categories.withColumn("theta", 1.0 / F.count(F.lit(1)).over(Window.partitionBy()))
    if tolerance is None:
        for _ in range(steps):
            theta = em_step(normal, theta, concentration)
        return theta
    before = None
    for _ in range(steps):
        after = em_step(normal, theta, concentration)
        rows = after.collect()
        theta = normal.sparkSession.createDataFrame(rows, after.schema)
        now = {r.category: r.theta for r in rows}
        if before is not None and all(abs(now[c] - before[c]) <= tolerance for c in now):
            break
        before = now
    return theta


def posterior(normal: DataFrame, theta: DataFrame) -> DataFrame:
    """site, category, mass."""
    weighted = normal.join(F.broadcast(theta), "category").withColumn("w", F.col("l") * F.col("theta"))
    return weighted.select("site", "category", (F.col("w") / F.sum("w").over(Window.partitionBy("site"))).alias("mass"))


def selection_table(post: DataFrame, grid: DataFrame, threshold: float = 0.9) -> DataFrame:
    """site, p_positive, p_purifying, mean_alpha, mean_beta, selection; calls are strict and positive is asked first."""
    m = post.join(F.broadcast(grid), "category")
    mass = lambda c: F.coalesce(F.sum(F.when(c, F.col("mass"))), F.lit(0.0))
    out = m.groupBy("site").agg(
        mass(F.col("beta") > F.col("alpha")).alias("p_positive"), mass(F.col("beta") < F.col("alpha")).alias("p_purifying"),
        F.sum(F.col("mass") * F.col("alpha")).alias("mean_alpha"), F.sum(F.col("mass") * F.col("beta")).alias("mean_beta"),
    )
    return out.withColumn("selection", _call(threshold))


def marginals(post: DataFrame, grid: DataFrame) -> DataFrame:
    """site, axis, bin, mass of both axes by grouping sets: one pass over the cells."""
    m = post.join(F.broadcast(grid), "category")
    sets = m.groupingSets([["site", "alpha_idx"], ["site", "beta_idx"]], "site", "alpha_idx", "beta_idx").agg(F.sum("mass").alias("mass"), F.grouping("alpha_idx").alias("g"))
    return sets.select("site", F.when(F.col("g") == 0, "alpha").otherwise("beta").alias("axis"), F.coalesce("alpha_idx", "beta_idx").alias("bin"), "mass")


def expectation(post: DataFrame, grid: DataFrame, value: Column, name: str) -> DataFrame:
    return post.join(F.broadcast(grid), "category").groupBy("site").agg(F.sum(F.col("mass") * value).alias(name))


def episodic_table(post: DataFrame, grid: DataFrame, prior_positive: float) -> DataFrame:
    """Two-rate mixtures: p(omega2 > 1), means and empirical Bayes factor, omega2 being beta over alpha."""
    from ..functions.scalars import bayes_factor

    m = post.join(F.broadcast(grid), "category")
    out = m.groupBy("site").agg(F.coalesce(F.sum(F.when(F.col("beta") > F.col("alpha"), F.col("mass"))), F.lit(0.0)).alias("p_positive"), F.sum(F.col("mass") * F.col("alpha")).alias("mean_alpha"))
    return out.withColumn("bayes_factor", bayes_factor(F.col("p_positive"), F.lit(prior_positive)))


def log_mean_exp(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Stable log of the mean of exponentials in each group."""
    shifted = rows.withColumn("_top", F.max(value).over(Window.partitionBy(*group)))
    return shifted.groupBy(*group).agg((F.max("_top") + F.ln(F.avg(F.exp(F.col(value) - F.col("_top"))))).alias("log_mean"))


def log_sum_exp(rows: DataFrame, group: list[str], value: str, name: str = "log_sum") -> DataFrame:
    shifted = rows.withColumn("_top", F.max(value).over(Window.partitionBy(*group)))
    return shifted.groupBy(*group).agg((F.max("_top") + F.ln(F.sum(F.exp(F.col(value) - F.col("_top"))))).alias(name))


def from_allocations(counts: DataFrame, retained: int) -> tuple[DataFrame, DataFrame]:
    """(site, category, mass; sites whose counts don't add up to the draws that were kept)."""
    mass = counts.withColumn("mass", F.col("n") / retained).select("site", "category", "mass")
    return mass, counts.groupBy("site").agg(F.sum("n").alias("n")).filter(F.col("n") != retained)


def emission_normalise(emission: DataFrame) -> DataFrame:
    return emission.withColumn("relative", F.col("logl") - F.max("logl").over(Window.partitionBy("site")))


def proxy_weights(emission: DataFrame, state: str, pseudo: float = 0.05) -> DataFrame:
    """state, weight of a reset chain for searches: each state's share of every site's likelihood, added up."""
    site = Window.partitionBy("site")
    l = F.exp(F.greatest(F.lit(-60.0), F.col("logl") - F.max("logl").over(site)))  # noqa: E741
    share = emission.select(state, "site", l.alias("_l")).select(state, (F.col("_l") / F.sum("_l").over(site)).alias("_r"))
    summed = share.groupBy(state).agg((F.sum("_r") + pseudo).alias("weight"))
    return summed.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def occupancy(post: DataFrame) -> DataFrame:
    return post.groupBy("state").agg(F.sum("p").alias("sites"))


def burden(rows: DataFrame) -> DataFrame:
    """rows: site, branch, k, logl, prior -> site, log_bf, map_branch, map_k: shift evidence over all branches and intensities."""
    joint = rows.withColumn("x", F.col("logl") + F.ln("prior"))
    total = log_sum_exp(joint, ["site"], "x", "log_bf")
    best = joint.groupBy("site").agg(F.max_by(F.struct("branch", "k"), F.struct(F.col("x"), -F.col("branch"), -F.col("k"))).alias("m"))
    return total.join(best, "site").select("site", "log_bf", F.col("m.branch").alias("map_branch"), F.col("m.k").alias("map_k"))


def sites_per_branch(rows: DataFrame) -> DataFrame:
    """Expected number of sites that shift on each branch."""
    joint = rows.withColumn("x", F.col("logl") + F.ln("prior"))
    w = joint.withColumn("_top", F.max("x").over(Window.partitionBy("site"))).withColumn("w", F.exp(F.col("x") - F.col("_top")))
    return w.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("site"))).groupBy("branch").agg(F.sum("p").alias("expected_sites"))
