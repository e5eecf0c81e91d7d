"""Rolling scans of all triplets of one alignment by blocks of sites.

A block of sites is one row with the bases of all taxa; the events of a triplet in it are one row, too. Counts left and right of
an event reach into the blocks beside it, of which each row gets the nearest events. No task ever orders a whole triplet.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chains import kept, spread

_TRIPLET = ["a", "b", "c"]


def event_blocks(aln: DataFrame, block: int = 8192) -> DataFrame:
    """a, b, c, blk, site, state (of the events in a block of sites, in order); as ``triplet_events``, a row for each triplet with events in the block."""
    cell = (F.col("site") % block).cast("long") * (1 << 24) + F.col("taxon") * 4 + F.col("base")
    packed = aln.filter("base IS NOT NULL").groupBy(F.floor(F.col("site") / block).alias("blk")).agg(F.collect_list(cell).alias("cells"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for blk, cells in zip(frame["blk"], frame["cells"], strict=True):
                at, who = cells >> 24, (cells & ((1 << 24) - 1)) >> 2
                taxa, column = np.unique(who, return_inverse=True)
                bases = np.full((len(taxa), block), -1, np.int8)
                bases[column, at] = cells & 3
                out = []
                for i, j, k in itertools.combinations(range(len(taxa)), 3):
                    x, y, z = bases[i], bases[j], bases[k]
                    xy, xz, yz = x == y, x == z, y == z
                    found = np.flatnonzero((x >= 0) & (y >= 0) & (z >= 0) & (xy ^ xz ^ yz) & ~(xy & xz))
                    if len(found):
                        state = np.where(xy[found], 0, np.where(xz[found], 1, 2)).astype(np.int8)
                        out.append((int(taxa[i]), int(taxa[j]), int(taxa[k]), int(blk), (found + int(blk) * block).astype(np.int32), state))
                if out:
                    yield pd.DataFrame(out, columns=[*_TRIPLET, "blk", "site", "state"])

    return packed.mapInPandas(run, "a int, b int, c int, blk long, site array<int>, state array<tinyint>")


def g_table(width: int) -> np.ndarray:
    """g of every pair of full windows, by (first count * (width + 1) + second count) left and right; nine digits."""
    xlogx = [0.0] + [k * math.log(k) for k in range(1, 2 * width + 1)]
    out = np.full(((width + 1) ** 2, (width + 1) ** 2), np.nan)
    ways = [(p, q, width - p - q) for p in range(width + 1) for q in range(width + 1 - p)]
    for l, r in itertools.product(ways, ways):  # noqa: E741
        cells, columns = sum(xlogx[v] for v in (*l, *r)), sum(xlogx[p + q] for p, q in zip(l, r, strict=True))
        out[l[0] * (width + 1) + l[1], r[0] * (width + 1) + r[1]] = round(2 * (cells - columns - 2 * xlogx[width] + xlogx[2 * width]), 9)
    return out


def scan_states(states: np.ndarray, before: int, n: int, width: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(g, peak) of the ``n`` events after the first ``before`` ones; g is not a number where a window is not full."""
    one, two = (np.concatenate([[0], np.cumsum(states == s)]) for s in (0, 1))
    g = np.full(len(states) + 2, np.nan)  # g[p + 1] is that of event p
    at = np.arange(width, len(states) - width + 1)
    if len(at):
        left = (one[at] - one[at - width]) * (width + 1) + two[at] - two[at - width]
        right = (one[at + width] - one[at]) * (width + 1) + two[at + width] - two[at]
        g[at + 1] = table[left, right]
    own, level = g[before + 1 : before + n + 1], np.nan_to_num(g)
    peak = (own >= level[before : before + n]) & (own > level[before + 2 : before + n + 2])
    return own, peak


def scanned(blocks: DataFrame, width: int, pick: Callable[[tuple, int, np.ndarray, np.ndarray], pd.DataFrame | None], schema: str) -> DataFrame:
    """``pick(row, number of events before the block, g, peak)`` of each row of ``event_blocks``, as ``rolling_scan`` gives them."""
    blocks = kept(blocks)
    halo = width + 1
    order = Window.partitionBy(*_TRIPLET).orderBy("blk")
    n = F.size("state")
    edges = blocks.select(*_TRIPLET, "blk", n.alias("n"), F.slice("state", 1, halo).alias("head"), F.slice("state", F.greatest(F.lit(1), n - halo + 1), F.lit(halo)).alias("tail"))
    # a row holds an event at least, so so many rows hold the halo
    left = F.flatten(F.collect_list("tail").over(order.rowsBetween(-halo, -1)))
    right = F.flatten(F.collect_list("head").over(order.rowsBetween(1, halo)))
    base = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(*_TRIPLET, "blk", base.alias("base"), left.alias("left"), right.alias("right"))
    edges = edges.select(*_TRIPLET, "blk", "base", F.slice("left", F.greatest(F.lit(1), F.size("left") - halo + 1), F.lit(halo)).alias("left"), F.slice("right", 1, halo).alias("right"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = g_table(width)
        for frame in frames:
            for row in frame.itertuples(index=False):
                states = np.concatenate([row.left, row.state, row.right]).astype(np.int8)
                out = pick(row, int(row.base), *scan_states(states, len(row.left), len(row.state), width, table))
                if out is not None and len(out):
                    yield out

    return spread(blocks.join(edges, [*_TRIPLET, "blk"]), blocks.count()).mapInPandas(run, schema)


def peaks(blocks: DataFrame, width: int) -> DataFrame:
    """a, b, c, site, event, g of every peak."""

    def pick(row, base: int, g: np.ndarray, peak: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(peak)
        return pd.DataFrame({"a": row.a, "b": row.b, "c": row.c, "site": row.site[at], "event": (base + 1 + at).astype(np.int32), "g": g[at]})

    return scanned(blocks, width, pick, "a int, b int, c int, site int, event int, g double")


def strongest(blocks: DataFrame, width: int, k: int) -> DataFrame:
    """a, b, c, site, g of the k events of each block with the largest g, ties by site: all that can be among the k first of all."""

    def pick(row, base: int, g: np.ndarray, peak: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(~np.isnan(g))
        at = at[np.argsort(-g[at], kind="stable")[:k]]
        return pd.DataFrame({"a": row.a, "b": row.b, "c": row.c, "site": row.site[at], "g": g[at]})

    return scanned(blocks, width, pick, "a int, b int, c int, site int, g double")


def signal_blocks(blocks: DataFrame, width: int, least: float) -> DataFrame:
    """a, b, c, blk, event, site, state, found (places of the peaks of at least ``least``), g (of those), tests (events with a g)."""

    def pick(row, base: int, g: np.ndarray, peak: np.ndarray) -> pd.DataFrame:
        found = np.flatnonzero(peak & (g >= least))
        event = np.arange(base + 1, base + 1 + len(g), dtype=np.int32)
        one = (row.a, row.b, row.c, row.blk, event, row.site, row.state, found.astype(np.int32), g[found], int((~np.isnan(g)).sum()))
        return pd.DataFrame([one], columns=[*_TRIPLET, "blk", "event", "site", "state", "found", "g", "tests"])

    return scanned(blocks, width, pick, "a int, b int, c int, blk long, event array<int>, site array<int>, state array<tinyint>, found array<int>, g array<double>, tests long")
