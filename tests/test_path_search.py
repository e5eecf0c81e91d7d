"""Interval prices and the search for a path of trees against brute force."""

import itertools
import random

import numpy as np
import pytest

from treeline.kernels import topology
from treeline.operators import path_search
from treeline.operators.chains import Chains


def test_prices_are_of_the_best_interval(spark):
    """Every interval tried, with the candidate in it and the best path on both sides."""
    rng = np.random.default_rng(5)
    n, k = 40, 3
    cost = rng.integers(0, 6, (n, k)).astype(float)
    away = np.array([[0, 1, 2], [1, 0, 1], [2, 1, 0]], float)
    move = np.where(np.eye(k, dtype=bool), 0.0, 4 + away)
    extra = {0: rng.integers(0, 3, n).astype(float), 1: np.where(np.arange(n) // 10 == 2, 0.0, 9.0)}
    d, master = {0: [1.0, 2.0, 2.0], 1: [2.0, 1.0, 3.0]}, {0: 1.0, 1: 2.0}

    def best(part):
        at = part[0]
        for c in part[1:]:
            at = (at[:, None] + move).min(0) + c
        return at

    def back(part):
        at = part[-1]
        for c in part[-2::-1]:
            at = c + (move + at[None, :]).min(1)
        return at

    whole = best(cost).min()
    rows = spark.createDataFrame([(t + 7, s, -float(cost[t, s])) for t in range(n) for s in range(k)], "site long, state int, value double")
    chains = Chains(rows, [], {0: (np.zeros(k), -move)}, block=6, fan=2)
    from pyspark.sql import functions as F

    margins = chains.margins().select("site", *[F.transform(x, lambda v: -v).alias(x) for x in ("upto", "onward")])
    scores = spark.createDataFrame([(c, t + 7, float(x[t])) for c, x in extra.items() for t in range(n)], "candidate int, site long, score double")
    got = {r["candidate"]: r["gain"] for r in path_search.interval_prices(margins, scores, d, master, whole, 4.0, 1.0, 0.25, block=9).collect()}
    for c, x in extra.items():
        step = 4 + np.array(d[c])
        want = min(
            (0 if a == 0 else (best(cost[:a]) + step).min()) + (x[a:b] + 0.25 * master[c]).sum() + (0 if b == n else (step + back(cost[b:])).min())
            for a, b in itertools.combinations(range(n + 1), 2)
        )
        assert got[c] == pytest.approx(whole - want)


def trees_of(names):
    """All rooted binary trees."""
    if len(names) == 1:
        return [names[0]]
    found = {}
    for n in range(1, len(names)):
        for left in itertools.combinations(names, n):
            rest = tuple(x for x in names if x not in left)
            for a in trees_of(left):
                for b in trees_of(rest):
                    t = topology.canonical((a, b))
                    found[topology.rooted_signature(t)] = t
    return list(found.values())


def test_search_is_brute_force_on_a_small_graph(spark):
    """Four taxa, an alignment of three trees: the search over all it can reach costs what the best of all paths over all 15 trees costs."""
    rng = random.Random(3)
    rows, site = [], 0
    for one, two in (("01", 30), ("02", 30), ("03", 30)):
        for _ in range(two):
            site += 1
            a, b = rng.sample(range(4), 2)
            for taxon in range(4):
                base = a if str(taxon) in one else b
                rows.append((taxon, site, base if rng.random() > 0.05 else rng.randrange(4)))
    rows[8] = (rows[8][0], rows[8][1], None)
    aln = spark.createDataFrame(rows, "taxon int, site int, base int")
    settings = path_search.Settings(breakpoint=3.0, endpoint=1.0, span=0.01, states=15, rounds=8, screen=15, frontier=8, block=16, fan=4)
    search = path_search.PathSearch(aln, 4, settings)
    every = trees_of(tuple("0123"))
    assert len(every) == 15
    found = search.run(every[0])
    signatures = [topology.rooted_signature(t) for t in every]
    links = {frozenset((k, signatures.index(topology.rooted_signature(t)))) for k, x in enumerate(every) for _, _, t in topology.spr_moves(x)}
    away = path_search._distances(15, links)
    columns = {str(t): np.zeros(site, int) for t in range(4)}
    for taxon, at, base in rows:
        columns[str(taxon)][at - 1] = 0 if base is None else 1 << base
    cost = np.stack([topology.fitch(t, columns) for t in every], 1).astype(float)
    best = np.inf
    for master in range(15):
        e = cost + 0.01 * away[master][None, :]
        at = e[0]
        for c in e[1:]:
            at = np.minimum(at, (at[:, None] + 3.0 + away).min(0)) + c
        best = min(best, at.min())
    assert found.objective == pytest.approx(best)
    runs = [r.asDict() for r in search.runs(found).orderBy("start").collect()]
    assert runs[0]["start"] == 1 and runs[-1]["end"] == site and len(runs) == 3
    assert all(a["end"] + 1 == b["start"] for a, b in itertools.pairwise(runs))
    costs = [r[1] for r in found.rounds]
    assert costs == sorted(costs, reverse=True)


def test_margins_meet(spark):
    """Up to a site and on from it: the best sum, the site counted once, is the best score at every site."""
    rng = np.random.default_rng(1)
    e = rng.normal(size=(50, 3))
    rows = spark.createDataFrame([(t, s, float(e[t, s])) for t in range(50) for s in range(3)], "site long, state int, value double")
    chains = Chains(rows, [], {0: (np.zeros(3), np.where(np.eye(3, dtype=bool), 0.0, -1.5))}, block=8, fan=2)
    total = chains.totals("most").first()["total"]
    for r in chains.margins().collect():
        assert max(np.array(r["upto"]) + np.array(r["onward"]) - e[r["site"]]) == pytest.approx(total)
