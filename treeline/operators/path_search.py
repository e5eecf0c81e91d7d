"""Rooted trees along an alignment: column generation over a graph of trees, with exact prices of intervals.

A path gives every site a tree. It pays each site's parsimony, a price for every change of tree (a
breakpoint, and one more for each rooted move between the trees), and for each site the distance of its tree from a
master tree. The search solves this exactly over the trees it holds, prices every tree near them by the
best single interval in which it could replace the path, adds the best and solves again.

Sites are never in one task: the alignment is cut into blocks once, and each pass scores, solves or prices a block's
sites for all trees where they are. Prices are running minima of two levels. The driver holds trees and a number or
two for each; their number is bounded by the search's arguments.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import topology
from .alignment import patterns
from .chains import Chains, Model, kept


def interval_prices(margins: DataFrame, scores: DataFrame, distances: dict[int, list[float]], master: dict[int, float], objective: float, breakpoint: float, endpoint: float, span: float = 0.0, block: int = 4096) -> DataFrame:
    """candidate, gain: how much cheaper the path becomes if the candidate takes its best single interval; below 0 if none helps.

    margins: site, upto, onward (costs of all states, own site included), without gaps; scores: candidate, site, score.
    distances: of each candidate to all states; master: to the master. Entering or leaving costs the breakpoint
    and the endpoint price times the distance; at the ends of the chain it is free.
    """
    spark = margins.sparkSession
    frame = spark.createDataFrame([(c, [float(x) for x in d], float(master[c])) for c, d in distances.items()], "candidate int, away array<double>, from_master double")
    cost = lambda side: F.array_min(F.zip_with(side, "away", lambda x, d: x + breakpoint + endpoint * d))
    moved = margins.crossJoin(F.broadcast(frame))
    enter = moved.select((F.col("site") + 1).alias("site"), "candidate", cost("upto").alias("enter"))
    leave = moved.select((F.col("site") - 1).alias("site"), "candidate", cost("onward").alias("leave"))
    own = scores.join(F.broadcast(frame.select("candidate", "from_master")), "candidate").select("candidate", "site", (F.col("score") + span * F.col("from_master")).alias("own"))
    rows = own.join(enter, ["candidate", "site"], "left").join(leave, ["candidate", "site"], "left").fillna(0.0, ["enter", "leave"])
    rows = rows.withColumn("_b", F.floor(F.col("site") / block))
    within = Window.partitionBy("candidate", "_b").orderBy("site").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_p", F.sum("own").over(within)).withColumn("_a", F.col("enter") - (F.col("_p") - F.col("own")))
    rows = rows.withColumn("_m", F.min("_a").over(within))
    # one row for each block: what all blocks before it add, and the best start within them
    blocks = rows.groupBy("candidate", "_b").agg(F.sum("own").alias("_t"), F.min("_a").alias("_low"))
    earlier = Window.partitionBy("candidate").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_o", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)))
    blocks = blocks.withColumn("_e", F.min(F.col("_low") - F.col("_o")).over(earlier)).select("candidate", "_b", "_o", "_e")
    whole = rows.join(blocks, ["candidate", "_b"])
    start = F.least(F.col("_m") - F.col("_o"), F.coalesce("_e", F.lit(float("inf"))))
    best = whole.select("candidate", (start + F.col("_p") + F.col("_o") + F.col("leave")).alias("v")).groupBy("candidate").agg(F.min("v").alias("v"))
    return best.select("candidate", (F.lit(float(objective)) - F.col("v")).alias("gain"))


def evenly_spaced(n: int, most: int) -> list[int]:
    return list(range(n)) if n <= most else [min(n - 1, int((k + 0.5) * n / most)) for k in range(most)]


@dataclass
class Settings:
    """Prices and bounds of a search."""

    breakpoint: float = 4.0
    endpoint: float = 1.0
    span: float = 0.002
    states: int = 36
    rounds: int = 10
    screen: int = 72
    frontier: int = 4
    near: int = 2
    sample: int = 48
    block: int = 512
    fan: int = 32


@dataclass
class Found:
    """What a search ends with. ``path``: site, state; ``trees`` by state; ``rounds``: trees, objective and best gain of each."""

    path: DataFrame
    trees: list[topology.Nested]
    objective: float
    master: int
    rounds: list[tuple[int, float, float]] = field(default_factory=list)


class PathSearch:
    """aln: taxon (0 to ``taxa`` - 1), site, base; null bases fit all."""

    def __init__(self, aln: DataFrame, taxa: int, settings: Settings | None = None):
        self.taxa, self.settings = taxa, settings or Settings()
        sites, _ = patterns(aln, taxa)
        # sites that tell trees apart: two bases at least are seen more than once
        often = [(F.length("pattern") - F.length(F.replace("pattern", F.lit(x), F.lit(""))) > 1).cast("int") for x in "0123"]
        self.sites = kept(sites.select(F.col("site").cast("long").alias("site"), "pattern", (sum(often[1:], often[0]) > 1).alias("telling")))
        codes = F.transform(F.sequence(F.lit(1), F.lit(taxa)), lambda k: F.substring("pattern", k, F.lit(1)).cast("tinyint"))
        self.chains = Chains(self.sites.select("site", codes.alias("codes")), [], {0: (np.zeros(1), np.zeros((1, 1)))}, block=self.settings.block, fan=self.settings.fan, values="codes")
        # a bounded sample of them, for screening
        telling = self.sites.filter("telling").withColumn("_b", F.floor(F.col("site") / 4096))
        counts = kept(telling.groupBy("_b").agg(F.count(F.lit(1)).alias("n")))
        wanted = evenly_spaced(counts.agg(F.sum("n")).first()[0] or 0, self.settings.sample)
        before = counts.select("_b", "n", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        some = before.filter(F.exists(F.array(*[F.lit(k) for k in wanted]), lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("n")))) if wanted else before.limit(0)
        placed = telling.join(F.broadcast(some), "_b").withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("site")) - 1)
        self.sample = self._masks([r["pattern"] for r in placed.filter(F.col("_k").isin(wanted)).orderBy("_k").collect()])

    @staticmethod
    def _masks(found: list[str]) -> dict[str, np.ndarray]:
        codes = np.array([[0 if c == "4" else 1 << int(c) for c in p] for p in found], int).reshape(len(found), -1)
        return {str(k): codes[:, k] for k in range(codes.shape[1])}

    @staticmethod
    def _costs(trees: list[topology.Nested]) -> Callable[[np.ndarray], np.ndarray]:
        """The parsimony of each tree at sites, from the sites' codes."""

        def costs(codes: np.ndarray) -> np.ndarray:
            columns = {str(k): np.where(c == 4, 0, 1 << np.minimum(c, 3)).astype(np.int8) for k, c in enumerate(codes.T)}
            return np.stack([topology.fitch(t, columns) for t in trees], 1).astype(float)

        return costs

    def _models(self, away: np.ndarray) -> dict[int, Model]:
        """For each master the prices of moves and of being away from it."""
        s, k = self.settings, len(away)
        move = np.where(np.eye(k, dtype=bool), 0.0, -(s.breakpoint + s.endpoint * away))
        return {m: (-s.span * away[m], move - s.span * away[m][None, :]) for m in range(k)}

    def solve(self, trees: list[topology.Nested], away: np.ndarray, signatures: list[str]) -> tuple[Chains, float, int]:
        """The chains of the best master, its cost and itself; all masters are solved in one job, and every block scores its own sites."""
        models, costs = self._models(away), self._costs(trees)
        emit = lambda codes: -costs(codes)
        every = self.chains.again(models, {m: tuple(range(len(away))) for m in models}, emit)
        cost = {r["_model"]: -r["total"] for r in every.totals("most").collect()}
        master = min(cost, key=lambda m: (round(cost[m], 9), signatures[m]))
        return self.chains.again({0: models[master]}, emit=emit), cost[master], master

    def run(self, start: topology.Nested, seeds: list[topology.Nested] | None = None) -> Found:
        """From one rooted tree over the taxa's numbers as names; seeds are trees near which the search would like to be."""
        s = self.settings
        trees, seeds = [topology.canonical(start)], seeds or [start]
        signatures = [topology.rooted_signature(trees[0])]
        links: set[frozenset[int]] = set()
        near = lambda t: min(topology.clade_distance(t, x) for x in seeds)
        rounds: list[tuple[int, float, float]] = []
        while True:
            away = _distances(len(trees), links)
            chains, objective, master = self.solve(trees, away, signatures)
            if len(rounds) >= s.rounds or len(trees) >= s.states:
                break
            occupied = {r["state"]: r["n"] for r in chains.paths().groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
            parents = sorted({*occupied, master}, key=lambda k: (-occupied.get(k, 0), signatures[k]))[: max(1, s.frontier)]
            if master not in parents:
                parents[-1] = master
            at = {x: k for k, x in enumerate(signatures)}
            fresh: dict[str, tuple] = {}
            old = len(links)
            for parent in parents:
                for _, _, tree in topology.spr_moves(trees[parent]):
                    name = topology.rooted_signature(tree)
                    if name in at:
                        links.add(frozenset((parent, at[name])))
                    elif name in fresh:
                        fresh[name][3].append(parent)
                    else:
                        proxy = int(topology.fitch(tree, self.sample).sum()) if self.sample else 0
                        fresh[name] = (proxy, near(tree), tree, [parent])
            if len(links) > old:
                away = _distances(len(trees), links)
                chains, objective, master = self.solve(trees, away, signatures)
            chosen = sorted(fresh, key=lambda n: (fresh[n][0], fresh[n][1], n))[: s.screen]
            if not chosen:
                break
            reach = np.array([[min(away[p][k] for p in fresh[n][3]) + 1.0 for k in range(len(trees))] for n in chosen])
            costs, extra = self._costs([fresh[n][2] for n in chosen]), s.span * reach[:, master]
            priced = chains.intervals(lambda codes, costs=costs, extra=extra: costs(codes) + extra, s.breakpoint + s.endpoint * reach)
            gain = {r["candidate"]: objective - r["cost"] for r in priced.collect()}
            order = sorted(range(len(chosen)), key=lambda c: (-round(gain[c], 9), fresh[chosen[c]][0], fresh[chosen[c]][1], chosen[c]))
            taken = [c for c in order if gain[c] > 1e-8][: s.frontier]
            taken += [c for c in order if c not in taken and fresh[chosen[c]][1] < near(trees[fresh[chosen[c]][3][0]])][: max(0, s.frontier + 1 - len(taken))]
            taken += [c for c in order if c not in taken][: max(0, s.frontier + s.near - len(taken))]
            taken = taken[: s.states - len(trees)]
            rounds.append((len(trees), objective, max(0.0, max(gain.values()))))
            for c in taken:
                links |= {frozenset((p, len(trees))) for p in fresh[chosen[c]][3]}
                trees.append(fresh[chosen[c]][2])
                signatures.append(chosen[c])
        rounds.append((len(trees), objective, 0.0))
        return Found(kept(chains.paths().select("site", "state")), trees, objective, master, rounds)

    def runs(self, found: Found) -> DataFrame:
        """start, end, tree (Newick) of the path's runs."""
        frame = found.path.sparkSession.createDataFrame([(k, topology.unit_newick(t)) for k, t in enumerate(found.trees)], T.StructType.fromDDL("state int, tree string"))
        left = found.path.select((F.col("site") + 1).alias("site"), F.col("state").alias("was"))
        heads = found.path.join(left, "site", "left").filter(~F.col("state").eqNullSafe(F.col("was"))).select("site", "state")
        # one row for each run from here on
        last = found.path.agg(F.max("site").alias("last"))
        ends = F.coalesce(F.lead("site").over(Window.orderBy("site")) - 1, F.col("last"))
        return kept(heads.crossJoin(F.broadcast(last)).select(F.col("site").alias("start"), ends.alias("end"), "state").join(F.broadcast(frame), "state").select("start", "end", "tree"))


def _distances(k: int, links: set[frozenset[int]]) -> np.ndarray:
    """Least numbers of moves between the trees of a connected graph."""
    d = np.where(np.eye(k, dtype=bool), 0.0, np.inf)
    for a, b in (tuple(x) for x in links):
        d[a, b] = d[b, a] = 1
    for m in range(k):
        d = np.minimum(d, d[:, m, None] + d[None, m, :])
    return d
