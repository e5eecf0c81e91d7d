"""Which states a reset chain needs: beam and floating search over subsets of states, scored over all sites.

Each round scores its new subsets in one job: every block of sites is folded once for each subset and
expected number of resets. Scores are remembered, so no subset is scored twice; the driver holds a number
for each subset, which the beam's width and the number of states bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chains import Chains, kept, reset_model

Subset = tuple[int, ...]


def reset_grid(sites: int, states: int) -> list[float]:
    """Expected numbers of resets that a search tries."""
    if states <= 1 or sites <= 1:
        return [0.0]
    top = min(48, max(6, 3 * (states - 1)))
    return sorted({*[x for x in (0, 0.25, 0.5, 1, 2, 4, 8, 16, 32) if x <= top], top})  # fixed values


def parameter_count(taxa: int, states: int) -> int:
    """A tree for each state, the rate model that they share, weights and rate of the chain."""
    return 2 * taxa + 6 if states <= 1 else 8 + states * (2 * taxa - 2) + states


def criterion_of(kind: str, logl: float, k: int, n: int) -> float:
    aic = 2 * k - 2 * logl
    if kind == "aic":
        return aic
    if kind == "bic":
        return k * math.log(n) - 2 * logl
    return aic + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf


class SubsetSearch:
    """rows: site, state (0 to ``states`` - 1), value, without gaps."""

    def __init__(self, rows: DataFrame, states: int, taxa: int, criterion: str = "aicc", block: int = 512, fan: int = 32):
        self.states, self.taxa, self.criterion, self.block, self.fan = states, taxa, criterion, block, fan
        self.rows = kept(rows.select("site", "state", "value"))
        self.lists = self.rows.groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("state", "value"))), lambda x: x["value"]).alias("v"))
        self.sites = self.lists.count()
        self.known: dict[Subset, dict] = {}

    def _weights(self, subsets: list[Subset], pseudo: float = 0.05) -> dict[Subset, np.ndarray]:
        """Each state's share of every site's likelihood, added up, for all subsets at once."""
        spark = self.rows.sparkSession
        frame = spark.createDataFrame(list(enumerate(map(list, subsets))), "subset int, members array<int>")
        values = F.transform("members", lambda m: F.element_at("v", m + 1))
        spread = F.transform("x", lambda x: F.exp(F.greatest(F.lit(-60.0), x - F.array_max("x"))))
        each = self.lists.crossJoin(F.broadcast(frame)).select("subset", values.alias("x")).select("subset", spread.alias("l"))
        share = each.select("subset", F.posexplode("l").alias("slot", "one"), F.aggregate("l", F.lit(0.0), lambda a, x: a + x).alias("all"))
        out = {s: np.full(len(s), pseudo) for s in subsets}
        for row in share.groupBy("subset", "slot").agg(F.sum(F.col("one") / F.col("all")).alias("w")).collect():
            out[subsets[row["subset"]]][row["slot"]] += row["w"]
        return {s: w / w.sum() for s, w in out.items()}

    def score(self, subsets: Iterable[Subset]) -> None:
        """Scores those that are not known yet, in one job."""
        new = sorted({tuple(sorted(set(s))) for s in subsets} - self.known.keys())
        if not new:
            return
        weights = self._weights(new)
        tried = [(s, e) for s in new for e in reset_grid(self.sites, len(s))]
        rate = lambda e: 0.0 if self.sites <= 1 else 1 - math.exp(-e / (self.sites - 1))
        models = {k: reset_model(weights[s], rate(e)) for k, (s, e) in enumerate(tried)}
        totals = Chains(self.rows, [], models, block=self.block, fan=self.fan, members={k: s for k, (s, _) in enumerate(tried)}).totals()
        got = {row["_model"]: row["total"] for row in totals.collect()}
        for s in new:
            logl, less = max((got[k], -e) for k, (t, e) in enumerate(tried) if t == s)
            k = parameter_count(self.taxa, len(s))
            self.known[s] = {"logl": logl, "resets": -less, "parameters": k, "criterion": criterion_of(self.criterion, logl, k, self.sites)}

    def _rank(self, s: Subset) -> tuple:
        return self.known[s]["criterion"], len(s), ",".join(map(str, s))

    def run(self, beam: int = 4, depth: int = 12) -> Subset:
        """The subset that the search ends at.

        The beam starts from state 0 and the best single states and adds a state in each round. From the
        best of all, states are dropped, added and swapped until nothing near is better.
        """
        singles = [(k,) for k in range(self.states)]
        self.score(singles)
        front = [(0,), *[s for s in sorted(singles, key=self._rank) if s != (0,)]][:beam]
        best = min(singles, key=self._rank)
        for _ in range(2, min(depth, self.states) + 1):
            wider = {tuple(sorted({*s, k})) for s in front for k in range(self.states) if k not in s}
            if not wider:
                break
            self.score(wider)
            front = sorted(wider, key=self._rank)[:beam]
            best = min(best, front[0], key=self._rank)
        for _ in range(max(12, min(512, 4 * self.states))):  # fixed values
            out = [k for k in range(self.states) if k not in best]
            near = {tuple(x for x in best if x != r) for r in best if len(best) > 1} | {tuple(sorted({*best, a})) for a in out}
            near |= {tuple(sorted({*(x for x in best if x != r), a})) for r in best for a in out}
            self.score(near)
            step = min(near, key=self._rank, default=best)
            if self._rank(step) >= self._rank(best):
                break
            best = step
        return best

    def hypotheses(self, chosen: Subset) -> DataFrame:
        """subset, states, logl, criterion, parameters, resets, chosen of all that were scored."""
        rows = [(",".join(map(str, s)), len(s), x["logl"], x["criterion"], x["parameters"], float(x["resets"]), s == chosen) for s, x in sorted(self.known.items())]
        schema = T.StructType.fromDDL("subset string, states int, logl double, criterion double, parameters int, resets double, chosen boolean")
        return self.rows.sparkSession.createDataFrame(rows, schema)
