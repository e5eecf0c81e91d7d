"""Gibbs sampling of a mixture over categories, with sites in partitions.

Given the weights, sites are independent, so a sweep is one pass over the partitions, and what comes
back is a count for each category. The collapsed sampler has no weights: each partition starts a sweep from
the counts of all, goes through its sites one by one, and the counts are reconciled after the sweep.
Uniform numbers are hashes of site, sweep and seed: a task that runs again draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import kept, spread


#: Sites that the collapsed sampler draws at once, from the same counts.
_RUN = 32
_BLOCK = "key binary, l binary, z binary"


def _uniform(keys: np.ndarray, sweep: int) -> np.ndarray:
    """A number from 0 to 1 for each site's hash in a sweep."""
    x = keys + np.uint64((sweep + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _blocks(packed: DataFrame, seed: int, size: int = 2048) -> DataFrame:
    """Sites in blocks: their hashes, likelihoods and categories (none yet, -1) as bytes, so that a sweep reads a few long rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), size):
                part = frame.iloc[lo : lo + size]
                one = (part["key"].to_numpy(np.int64).tobytes(), np.stack(part["l"].to_numpy()).tobytes(), np.full(len(part), -1, np.int32).tobytes())
                yield pd.DataFrame([one], columns=["key", "l", "z"])

    held = kept(packed.select(F.xxhash64("site", F.lit(seed)).alias("key"), "l").mapInPandas(run, _BLOCK))
    return kept(spread(held, held.count(), 64))


def _arrays(row, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.key, np.uint64), np.frombuffer(row.l).reshape(-1, k), np.frombuffer(row.z, np.int32)


def sparse(packed: DataFrame, cutoff: float) -> DataFrame:
    """site, l with cells below a share of the site's whole left out (0); the largest cell of a site always stays."""
    least = F.least(F.lit(cutoff), F.array_max("l"))
    return packed.select("site", F.transform("l", lambda x: F.when(x >= least, x).otherwise(0.0)).alias("l"))


def gibbs(packed: DataFrame, sweeps: int = 200, burn: int = 50, concentration: float = 0.5, seed: int = 1) -> tuple[np.ndarray, DataFrame]:
    """(mean weights, site and mass of its categories) of arrays (site, l) of normalised likelihoods.

    Both are means over the kept sweeps: of the weights' expectation given the counts, and of a site's masses
    given the weights. The driver holds a number for each category and kept sweep, and in a sweep one for each category and task.
    """
    first = packed.select(F.size("l").alias("k")).first()
    k = first["k"] if first else 0
    if not k:
        return np.empty(0), packed.select("site", F.col("l").alias("mass"))
    held = _blocks(packed, seed)
    rng, theta, drawn, means = np.random.default_rng(seed), np.full(k, 1 / k), [], []
    for sweep in range(sweeps):
        now = theta

        def allocate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts = np.zeros(k)
            for frame in frames:
                for row in frame.itertuples(index=False):
                    keys, l, _ = _arrays(row, k)  # noqa: E741
                    reach = np.cumsum(l * now, 1)  # noqa: B023
                    at = (reach < (_uniform(keys, sweep) * reach[:, -1])[:, None]).sum(1)  # noqa: B023
                    counts += np.bincount(np.minimum(at, k - 1), minlength=k)
            yield pd.DataFrame({"category": np.arange(k, dtype=np.int32), "n": counts})

        each = held.mapInPandas(allocate, "category int, n double")
        counts = np.zeros(k)
        for r in each.collect():
            counts[r["category"]] += r["n"]
        theta = rng.dirichlet(counts + concentration)
        if sweep >= burn:
            drawn.append(theta)
            means.append((counts + concentration) / (counts.sum() + concentration * k))
    whole = np.array(drawn)

    def average(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            mass = []
            for row in frame["l"]:
                p = whole * row
                mass.append((p / p.sum(1, keepdims=True)).mean(0))
            yield pd.DataFrame({"site": frame["site"], "mass": mass})

    kind = dict(packed.dtypes)["site"]
    return np.mean(means, 0), packed.select("site", "l").mapInPandas(average, f"site {kind}, mass array<double>")


def gibbs_collapsed(packed: DataFrame, sweeps: int = 60, burn: int = 20, concentration: float = 0.5, seed: int = 1) -> np.ndarray:
    """Mean weights by the collapsed sampler: a site's category is drawn by its likelihoods times the counts of all others.

    The first sweep draws by likelihoods alone, as the other sampler's does: counts that grow from nothing would hold on to where
    the first sites fell. Counts of other partitions are those at the sweep's start; runs of 32 sites are drawn from the counts at
    the run's start, each without its own. Allocations are the checkpointed state.
    """
    first = packed.select(F.size("l").alias("k")).first()
    k = first["k"] if first else 0
    if not k:
        return np.empty(0)
    state = _blocks(packed, seed)
    counts, means = np.zeros(k), []
    for sweep in range(sweeps):
        before = counts

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = before.copy()  # noqa: B023
            for frame in frames:
                for row in frame.itertuples(index=False):
                    keys, l, was = _arrays(row, k)  # noqa: E741
                    u, z = _uniform(keys, sweep), was.copy()  # noqa: B023
                    for lo in range(0, len(z), _RUN if sweep else len(z)):  # noqa: B023
                        part = slice(lo, lo + _RUN if sweep else len(z))  # noqa: B023
                        own = (z[part, None] == np.arange(k)).astype(float)
                        weight = l[part] * (np.maximum(n - own, 0) + concentration) if sweep else l  # noqa: B023
                        reach = np.cumsum(weight, 1)
                        z[part] = np.minimum((reach < (u[part] * reach[:, -1])[:, None]).sum(1), k - 1)
                        n += np.bincount(z[part], minlength=k) - own.sum(0)
                    yield pd.DataFrame([(row.key, row.l, z.tobytes())], columns=["key", "l", "z"])

        def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = np.zeros(k, np.int64)
            for frame in frames:
                for z in frame["z"]:
                    n += np.bincount(np.frombuffer(z, np.int32), minlength=k)
            yield pd.DataFrame({"z": np.arange(k, dtype=np.int32), "n": n})

        state = kept(state.mapInPandas(draw, _BLOCK))
        counts = np.zeros(k)
        for r in state.select("z").mapInPandas(tally, "z int, n long").collect():
            counts[r["z"]] += r["n"]
        if sweep >= burn:
            means.append((counts + concentration) / (counts.sum() + concentration * k))
    return np.mean(means, 0)
