"""Chains by blocks against the kernels of whole chains; subset search and triplet plans against exhaustion."""

import itertools

import numpy as np
import pytest

from treeline.functions.scalars import combination_rank
from treeline.kernels import hmm, scan
from treeline.operators import chains, subset_search, triplets


def cells(spark, emissions, first=0):
    rows = [(c, first + t, s, float(e[t, s])) for c, e in emissions.items() for t in range(len(e)) for s in range(e.shape[1]) if np.isfinite(e[t, s])]
    return spark.createDataFrame(rows, "chain string, site long, state int, value double").repartition(3)


@pytest.mark.parametrize(("block", "fan"), [(1, 2), (7, 3), (64, 2), (1000, 32)])
def test_chains_are_the_kernels(spark, block, fan):
    """Chains of one and of many sites, impossible cells, and blocks from one site to all."""
    rng = np.random.default_rng(block)
    emissions = {"a": rng.normal(size=(90, 4)) * 2, "b": rng.normal(size=(1, 4)), "c": rng.normal(size=(13, 4))}
    emissions["c"][5, 1:3] = -np.inf
    w, q = np.array([0.4, 0.3, 0.2, 0.1]), 0.15
    model = chains.reset_model(w, q)
    if block == 1:
        emissions = {"c": emissions["c"], "b": emissions["b"]}
    got = chains.Chains(cells(spark, emissions, 5), ["chain"], {0: model}, block=block, fan=fan).decode({0: (w, q)}).toPandas()
    assert len(got) == sum(map(len, emissions.values()))
    for c, e in emissions.items():
        own, want = got[got.chain == c].sort_values("site"), hmm.decode(e, *model)
        assert np.allclose(np.stack(own.posterior), want["posterior"])
        assert own.state.tolist() == want["path"].tolist()
        assert np.allclose(own.switch, want["switch"], atol=1e-9)
        assert np.allclose(own.total, want["logl"])
        assert np.allclose(np.stack(own.resets), hmm.reset_chain(e, w, q)["resets"])


def test_ties_and_scores(spark):
    """Whole scores tie often; the path is the kernel's, and its score is the best."""
    rng = np.random.default_rng(2)
    e = rng.integers(-3, 1, size=(200, 3)).astype(float)
    model = chains.switch_model(3, 2)
    found = chains.Chains(cells(spark, {"x": e}), ["chain"], {0: model}, block=16, fan=3)
    path = found.decode().orderBy("site").toPandas().state.to_numpy()
    assert path.tolist() == hmm.decode(e, *model)["path"].tolist()
    score = e[np.arange(200), path].sum() - 2 * (np.diff(path) != 0).sum()
    assert found.totals("most").first()["total"] == score


def test_no_sites(spark):
    empty = spark.createDataFrame([], "site long, state int, value double")
    found = chains.Chains(empty, [], {0: chains.switch_model(2, 1)})
    assert found.decode().count() == found.totals().count() == 0


def test_folds():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(9, 3, 3))
    a[4, 1] = -np.inf
    whole = np.exp(a[0])
    best = a[0]
    for m in a[1:]:
        whole, best = whole @ np.exp(m), (best[:, :, None] + m[None]).max(1)
    assert np.allclose(scan.fold(a, scan.plus), np.log(whole))
    assert np.allclose(scan.fold(a, scan.most), best)


def test_weights_of_a_reset_chain(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=(60, 3)) * 2
    expected = [1.0, 6.0]
    rows = cells(spark, {"x": e}).drop("chain")
    w, totals, _ = chains.fit_resets(rows, 3, expected, steps=4, block=16, fan=4)
    for r, x in enumerate(expected):
        want, fit = hmm.fit_reset(e, x / 60, steps=4)
        assert np.allclose(w[r], want) and np.isclose(totals[r], fit["logl"])
    got = chains.rate_average(rows, 3, expected, steps=4, block=16, fan=4).orderBy("site", "state").toPandas()
    fits = [hmm.fit_reset(e, x / 60, steps=4)[1] for x in expected]
    share = np.exp([f["logl"] - fits[0]["logl"] for f in fits])
    want = sum(s * f["posterior"] for s, f in zip(share / share.sum(), fits, strict=True))
    assert np.allclose(got.posterior.to_numpy().reshape(60, 3), want)


def test_search_is_exhaustion_for_five_states(spark):
    """Three of five states have their own stretches; the search finds the subset that all subsets' scores name."""
    rng = np.random.default_rng(9)
    truth = np.repeat([0, 3, 1, 3], 60)
    e = rng.normal(-3, 0.4, size=(240, 5))
    e[np.arange(240), truth] += 2.5
    rows = cells(spark, {"x": e}).drop("chain")
    search = subset_search.SubsetSearch(rows, 5, taxa=4, criterion="bic", block=64, fan=4)
    best = search.run(beam=2)
    assert best == (0, 1, 3)
    search.score(s for n in range(1, 6) for s in itertools.combinations(range(5), n))
    assert len(search.known) == 31 and min(search.known, key=search._rank) == best
    w = hmm.proxy_weights(e[:, [0, 1, 3]])
    want = max(hmm.rapid_forward(e[:, [0, 1, 3]], x, w) for x in subset_search.reset_grid(240, 3))
    assert np.isclose(search.known[best]["logl"], want)
    assert search.hypotheses(best).filter("chosen").count() == 1


@pytest.mark.parametrize(("taxa", "most"), [(2, 10), (3, 1), (9, 84), (9, 83), (12, 5), (13, 90), (40, 3000)])
def test_plans(spark, taxa, most):
    """Every pair is covered, the budget is kept unless the cover needs more, and ranks name their triplets."""
    rows = [(r["rank"], r["a"], r["b"], r["c"]) for r in triplets.plan(spark, taxa, most).collect()]
    every = list(itertools.combinations(range(taxa), 3))
    assert len({r[0] for r in rows}) == len(rows) and all(every[r[0]] == r[1:] for r in rows)
    if len(every) <= most:
        assert len(rows) == len(every)
    else:
        pairs = {p for r in rows for p in itertools.combinations(r[1:], 2)}
        assert pairs == set(itertools.combinations(range(taxa), 2)) if taxa > 2 else not rows
        assert len(rows) == most or most < len(rows) <= taxa * (taxa - 1) // 2


def test_ranks_of_many_taxa(spark):
    """First, last and border ranks of a thousand taxa."""
    n = 1000
    total = n * (n - 1) * (n - 2) // 6
    ranks = sorted({0, 1, n - 3, n - 2, total - 1, total - 2, *[int(x) for x in np.random.default_rng(1).integers(0, total, 200)]})
    frame = triplets.unranked(spark.createDataFrame([(r,) for r in ranks], "rank long"), n)
    from pyspark.sql import functions as F

    back = frame.withColumn("again", combination_rank(F.col("a"), F.col("b"), F.col("c"), F.lit(n))).collect()
    assert all(r["again"] == r["rank"] and 0 <= r["a"] < r["b"] < r["c"] < n for r in back)
