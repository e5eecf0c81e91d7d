"""Covers of all pairs, made without a shuffle, against sets."""

import pytest
from pyspark.sql import functions as F

from treeline.operators import triplets as P


def third(p, q, n):
    h = ((p + 1) * 0x9E3779B1 % 2**32 ^ (q + 1) * 0x85EBCA77 % 2**32) % (n - 2)
    h += h >= p
    return h + (h >= q)


@pytest.mark.parametrize("taxa", [3, 4, 5, 8, 31, 120, 401])
def test_cover_is_the_set_of_the_triplets_of_all_pairs(spark, taxa, monkeypatch):
    monkeypatch.setattr(P, "_BLOCK", 1000)
    got = [tuple(r) for r in P.pair_cover(spark, taxa).select("a", "b", "c").collect()]
    want = {tuple(sorted((p, q, third(p, q, taxa)))) for p in range(taxa) for q in range(p + 1, taxa)}
    assert len(got) == len(want) and set(got) == want


def test_a_cover_beyond_the_budget_shuffles_nothing(spark):
    plan = P.plan(spark, 401, 6000)
    ranks = P.unranked(plan.select("rank"), 401)
    assert plan.exceptAll(ranks.select(plan.columns)).isEmpty() and ranks.count() == plan.count() > 6000
    pairs = P.pairs_held(plan, 401)
    for frame in (plan, pairs):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == pairs.distinct().count() == 401 * 400 // 2


@pytest.mark.parametrize("taxa, most", [(2, 10), (3, 10), (12, 500), (60, 700), (60, 2000), (60, 30000)])
def test_pairs_are_all_pairs_of_the_plan(spark, taxa, most):
    three = P.plan(spark, taxa, most)
    got = sorted(tuple(r) for r in P.pairs_held(three, taxa).collect())
    sides = F.array(*[F.array(x, y) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])
    want = sorted(tuple(r[0]) for r in three.select(F.explode(sides)).distinct().collect())
    assert got == want and len(got) == (taxa * (taxa - 1) // 2 if taxa > 2 else 0)


def test_a_plan_without_a_pairs_triplet_lacks_the_pair(spark):
    three = P.plan(spark, 30, 10).filter("NOT (a = 0 AND b = 1) AND NOT (a = 0 AND c = 1) AND NOT (b = 0 AND c = 1)")
    assert (0, 1) not in [tuple(r) for r in P.pairs_held(three, 30).collect()]
