"""Signals of recombination, chains, branch mixtures and settings of simulations, against brute force and closed forms."""

import itertools
import json

import numpy as np
import pytest

from treeline.kernels import hmm, inference, simulate
from treeline.operators import analyses as X
from treeline.operators import branch_mixtures as B
from treeline.operators import signals as Z
from treeline.operators import simulation as S
from treeline.operators import tables as P
from treeline.operators.windows import rolling_scan
from treeline.plans import pipeline


def test_switches_are_those_of_all_paths():
    positions, states, sites, accuracy, expected = np.array([3, 9, 10, 30, 41]), np.array([0, 0, 1, 1, 2]), 50, 0.8, np.array([0.5, 4.0])
    by_rate = []
    for x in expected:
        total, switch = 0.0, np.zeros(4)
        for path in itertools.product(range(3), repeat=5):
            p = np.prod([accuracy if a == b else (1 - accuracy) / 2 for a, b in zip(path, states, strict=True)]) / 3
            for t in range(4):
                decay = np.exp(-1.5 * x / (sites - 1) * (positions[t + 1] - positions[t]))
                p *= decay + (1 - decay) / 3 if path[t] == path[t + 1] else (1 - decay) / 3
            total += p
            switch += p * np.array([path[t] != path[t + 1] for t in range(4)])
        by_rate.append((total, switch / total))
    weight = np.array([t for t, _ in by_rate]) / sum(t for t, _ in by_rate)
    got, share = hmm.triplet_switches(positions, states, expected, sites, accuracy)
    assert np.allclose(share, weight) and np.allclose(got, sum(w * s for w, (_, s) in zip(weight, by_rate, strict=True)))


def test_climb_and_positions():
    assert hmm.climb_mode(np.array([0.1, 0.2, 0.9, 0.2, 0.0, 0.5, 0.1]), 1) == (2, 0, 4)
    assert hmm.climb_mode(np.array([0.3]), 0) == (0, 0, 0)
    assert [hmm.mass_position(np.array([0.0, 1, 1, 2]), q) for q in (0.25, 0.5, 0.975)] == [1, 2, 3] and hmm.mass_position(np.zeros(5), 0.5) == 2


def test_weighted_intervals_are_the_best_of_all():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        at, w = np.sort(rng.choice(60, n, replace=False)), rng.normal(1, 2, n)
        most = int(rng.integers(1, 5))
        legal = [c for k in range(most + 1) for c in itertools.combinations(range(n), k) if all(at[b] - at[a] >= 10 for a, b in itertools.pairwise(c))]
        assert np.isclose(w[hmm.weighted_intervals(at, at, w, 10, most)].sum(), max(w[list(c)].sum() for c in legal))


def test_rapid_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(5)
    logl = rng.normal(-2, 1, (5, 2))
    weights = hmm.proxy_weights(logl)
    assert np.isclose(weights.sum(), 1)
    q = 1 - np.exp(-1.5 / 4)
    total = sum(
        weights[p[0]] * np.prod([(1 - q) * (p[t] == p[t + 1]) + q * weights[p[t + 1]] for t in range(4)]) * np.exp(sum(logl[t, p[t]] for t in range(5)))
        for p in itertools.product(range(2), repeat=5)
    )
    assert np.isclose(hmm.rapid_forward(logl, 1.5, weights), np.log(total))
    assert np.isclose(hmm.rapid_forward(logl, 0.0, weights), np.log((weights * np.exp(logl.sum(0))).sum()))


def test_states_without_a_run_are_dropped():
    logl = np.full((60, 3), -5.0)
    logl[:30, 0], logl[30:, 1], logl[14, 2] = -1, -1, -0.5
    kept, path = hmm.low_switch_states(logl, 0.05, 5)
    assert list(kept) == [0, 1] and list(path) == [0] * 30 + [1] * 30


def test_cuts_are_spread_first():
    at, e = np.array([100, 101, 102, 103, 400, 10, 595]), np.array([9.0, 8, 7, 6, 1, 99, 99])
    assert list(hmm.spread_cuts(at, e, 600, 3, 30)) == [0, 4, 1]  # ends are too near; then those apart; then by evidence
    assert list(hmm.spread_cuts(at, e, 600, 12, 30)) == [0, 1, 2, 3, 4] and list(hmm.spread_cuts(np.array([]), np.array([]), 600)) == []


def planted(spark, cut=300, n=120):
    """Events of four triplets whose state changes at a site, one event in five sites, one of six astray."""
    rows = [(0, 1, c, 5 * k + 1, (0 if 5 * k + 1 < cut else 1) if (k + c) % 6 else 2, k + 1) for c in range(2, 6) for k in range(n)]
    return rolling_scan(spark.createDataFrame(rows, "a int, b int, c int, site int, state int, event int"), 10)


def test_refined_signals_and_their_consensus(spark):
    signals = Z.refine(planted(spark), 600, 10)
    rows = signals.toPandas()
    near = rows[(rows["breakpoint"] - 300).abs() <= 10]
    assert set(near["c"]) == {2, 3, 4, 5} and (near["interval_low"] <= near["breakpoint"]).all() and (near["breakpoint"] <= near["interval_high"]).all()
    best = near.sort_values("g").iloc[-1]
    assert np.isclose(best["raw_p"], np.exp(-best["g"] / 2)) and np.isclose(best["adjusted_p"], min(1, best["raw_p"] * 4 * (120 - 19)), rtol=0.02)
    found = Z.merged(signals, 600).orderBy("rank").collect()
    assert abs(found[0]["breakpoint"] - 300) <= 10 and found[0]["triplets"] == 4
    assert all(abs(a["breakpoint"] - b["breakpoint"]) >= 15 for a, b in itertools.combinations(found, 2))
    assert Z.refine(planted(spark).filter("g < 0"), 600, 10).count() == 0 == Z.merged(signals.filter("false"), 600).count()


def test_gamma_categories(spark):
    c = B.candidate_categories(B.gamma_candidates(spark), 4, 8).toPandas()
    assert len(c) == 256 and np.allclose(c.groupby("category")["alpha"].mean(), 1)
    row = c[(c["omega_mean"] == 1) & (c["omega_shape"] == 1.3)].iloc[0]
    assert abs(row["positive"] - (1 - inference.gamma_p(1.3, 1.3))) < 1e-9
    assert B.refined_candidates(B.gamma_candidates(spark).filter("category = 21"), 0.3).count() == 27
    even = B.episodic_operators(spark.sql("SELECT 0 AS category, 1D AS alpha, 0.1D AS omega1, 2D AS omega2"), 3, even=True).toPandas()
    assert sorted(zip(even["node"], even["omega"], even["weight"], strict=True)) == [(0, 2.0, 1.0), (1, 0.1, 0.5), (1, 2.0, 0.5), (2, 0.1, 1.0)]


def test_settings_defaults_and_bounds(spark):
    texts = [None, "{bad", json.dumps({"codon": {"engine": "mg94", "omega": {"kind": "gamma", "mean": 3}}, "tree": {"population": {"points": [{"time": 9, "value": 1}, {"time": -2, "value": -1}]}}})]
    none, bad, given = S.normalised(spark.createDataFrame([(t,) for t in texts], "config string")).collect()
    assert none.tree == bad.tree and none.codon.alpha.kind == "fixed" and bad.codon.alpha.kind == "gamma" and none.seed == 20260814
    assert [(p.time, p.value) for p in given.tree.population.points] == [(0, 1e-8), (20, 1)] and (given.codon.omega.kind, given.codon.omega.mean, given.codon.omega.shape) == ("gamma", 3, 0.8)
    assert S.normalised(spark.createDataFrame([], "config string")).count() == 0


def test_coalescent_under_curves():
    rng = np.random.default_rng(1)
    flat = {"initial": 2, "population": [(0, 2.0), (1, 2.0)], "sampling": [(0, 0.0), (1, 0.0)]}
    heights = [simulate.coalescent_curves(2, rng, flat, 1.0, bins=64).children[0].length for _ in range(3000)]
    assert abs(np.mean(heights) - 2) < 0.12 and abs(np.std(heights) - 2) < 0.15  # exponential of the population, past the horizon too
    tree = simulate.coalescent_curves(12, rng, simulate.preset_curves("logistic", 20, 12), 20.0)
    names, todo = set(), [tree]
    while todo:
        node = todo.pop()
        assert node is tree or node.length >= 0
        names |= {node.name} if not node.children else set()
        todo += node.children
    assert names == {f"t{k}" for k in range(12)}


def test_trees_in_odd_results(spark):
    assert P.newick_texts(spark.range(3)).count() == 0
    rows = spark.createDataFrame([(None, None), (["(a);", None, "a;"], {"x": "(b)"})], "l array<string>, m map<string,string>")
    assert [tuple(r) for r in P.newick_texts(rows).collect()] == [("l.1", "(a);")]


@pytest.mark.parametrize("kind", pipeline.REGIONAL)
def test_regional_sources_cover_all_sites(spark, kind):
    nodes = [{"id": "s", "kind": "simulator", "parameters": {"taxa": 5, "codons": 40, "events": 1, "seed": 3}}, {"id": "r", "kind": kind}, {"id": "m", "kind": "selection", "modelId": "episodic", "parameters": {"nodes": 2}}]
    signals, failed = pipeline.run(spark, json.dumps({"schemaVersion": 1, "id": "x", "nodes": nodes}))
    rows = signals.filter("metric = 'p_positive'").toPandas()
    assert not failed and sorted(rows["key"].astype(int)) == list(range(1, 41)) and set(rows["dataset"]) == {"r0"}


def test_codons_belong_to_the_region_of_their_middle(spark):
    s = spark.createDataFrame([("d", "x", "AAACCCGGGTTT")], "dataset string, name string, sequence string")
    cut, trees, where = X.by_region(s, spark.createDataFrame([("d", 1, 4, "p"), ("d", 5, 5, "q"), ("d", 6, 6, "none"), ("d", 7, 12, "r")], "dataset string, start int, end int, newick string"))
    assert {r.dataset: r.sequence for r in cut.collect()} == {"d#1": "AAA", "d#2": "CCC", "d#3": "GGGTTT"} and trees.count() == 3
    assert {r.dataset: r["first"] for r in where.collect()} == {"d#1": 0, "d#2": 1, "d#3": 2}


def test_blocks_of_a_triplet_are_its_whole_chain(spark):
    rng = np.random.default_rng(4)
    n = 260
    site, state = np.cumsum(rng.integers(1, 5, n)), (np.arange(n) // 37 + (rng.random(n) < 0.2)) % 3
    rows = [(0, 1, c, int(s), int(x), k + 1) for c in (2, 3) for k, (s, x) in enumerate(zip(site, state, strict=True))]
    scan = rolling_scan(spark.createDataFrame(rows, "a int, b int, c int, site int, state int, event int"), 10)
    sites = int(site[-1]) + 3
    found = scan.filter("c = 2 AND peak AND g >= 4").orderBy("event").toPandas()
    at = found["event"].to_numpy() - 1
    want, _ = hmm.triplet_switches(site, state, len(at) * 2.0 ** np.linspace(-3, 3, 9), sites, 0.7)
    assert len(at) > 3
    stay = hmm.switch_stays(np.concatenate([[np.inf], np.diff(site)]), len(at) * 2.0 ** np.linspace(-3, 3, 9), sites)
    e = hmm.switch_emissions(state, 0.7)
    _, share = hmm.triplet_switches(site, state, len(at) * 2.0 ** np.linspace(-3, 3, 9), sites, 0.7)
    got = hmm.switch_block(stay, e, np.full((9, 3), 1 / 3), np.full((9, 3), 1 / 3)) @ share
    assert np.allclose(got[1:], want)
    order = ["c", "event"]
    whole, parts = (Z.refine(scan, sites, 10, block=b).toPandas().sort_values(order, ignore_index=True) for b in (4096, 16))
    assert len(whole) == 2 * len(at) and np.allclose(whole.to_numpy(float), parts.to_numpy(float))


def test_spaced_points_by_blocks_are_the_heaviest_set(spark):
    rng = np.random.default_rng(7)
    at, w = np.sort(rng.choice(900, 220, replace=False)), rng.integers(-3, 9, 220)
    rows = spark.createDataFrame([(int(a), int(x)) for a, x in zip(at, w, strict=True)] + [(5000, 1)], "breakpoint int, weight long")
    want = sorted(at[hmm.weighted_intervals(at, at, w.astype(float), 15, 61)].tolist()) + [5000]
    assert sorted(r.breakpoint for r in Z.spaced(rows, 15, 16).collect()) == want
    # memory of one number for each place, not for each place and member: a whole alignment of 200,000 sites
    many = spark.range(200_000).selectExpr("int(id) AS breakpoint", "1L AS weight")
    assert Z.spaced(many, 15).count() == 13_334


def test_cuts_of_many_candidates_are_those_of_the_kernel(spark):
    rng = np.random.default_rng(9)
    rows = [(d, int(x), float(round(s, 3))) for d in ("p", "q") for x, s in zip(rng.choice(4000, 300, replace=False), rng.random(300), strict=True)] + [("r", 50, 1.0), ("r", 20, 2.0)]
    got = Z.cuts(spark.createDataFrame(rows, "dataset string, breakpoint int, score double"), 4000, 12, 30).toPandas()
    for d in "pqr":
        at, s = (np.array([r[k] for r in rows if r[0] == d]) for k in (1, 2))
        assert got[got["dataset"] == d].sort_values("rank")["breakpoint"].tolist() == at[hmm.spread_cuts(at, s, 4000, 12, 30)].tolist()
