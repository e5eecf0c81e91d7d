"""Samplers over partitions: planted weights, masses of sites, the same draws again."""

import numpy as np

from treeline.operators import sampling


def packed(spark, n=600):
    rng = np.random.default_rng(2)
    theta = np.array([0.6, 0.25, 0.1, 0.05])
    z = rng.choice(4, n, p=theta)
    like = rng.random((n, 4)) * 0.01
    like[np.arange(n), z] = 1
    like /= like.sum(1, keepdims=True)
    return spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(like)], "site int, l array<double>").repartition(4).cache(), like, np.bincount(z, minlength=4) / n


def test_samplers_find_planted_weights(spark):
    rows, like, share = packed(spark)
    theta, mass = sampling.gibbs(rows, 30, 10, seed=5)
    assert np.abs(theta - share).max() < 0.05
    got = np.stack(mass.orderBy("site").toPandas().mass)
    want = like * theta
    want /= want.sum(1, keepdims=True)
    assert np.allclose(got.sum(1), 1) and np.abs(got - want).max() < 0.05
    again, _ = sampling.gibbs(rows, 30, 10, seed=5)
    assert np.array_equal(theta, again)
    thin, _ = sampling.gibbs(sampling.sparse(rows, 0.002), 30, 10, seed=5)
    assert np.abs(thin - share).max() < 0.05
    assert np.abs(sampling.gibbs_collapsed(rows, 12, 4) - share).max() < 0.05


def test_no_sites(spark):
    none = spark.createDataFrame([], "site int, l array<double>")
    theta, mass = sampling.gibbs(none, 3, 1)
    assert not len(theta) and mass.count() == 0 and not len(sampling.gibbs_collapsed(none, 3, 1))


def test_the_largest_cell_stays(spark):
    rows = spark.createDataFrame([(1, [0.4, 0.6]), (2, [0.999, 0.001])], "site int, l array<double>")
    got = {r["site"]: r["l"] for r in sampling.sparse(rows, 0.7).collect()}
    assert got == {1: [0.0, 0.6], 2: [0.999, 0.0]}


def test_a_collapsed_chain_does_not_keep_where_it_began(spark):
    """Sites that fit most categories: counts that grow from nothing hold the first draws for many sweeps."""
    rng = np.random.default_rng(8)
    like = np.where(rng.random((4000, 25)) < 0.7, rng.uniform(0.6, 1, (4000, 25)), 1e-4)
    like /= like.sum(1, keepdims=True)
    rows = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(like)], "site int, l array<double>").coalesce(1).cache()
    theta = np.full(25, 1 / 25)
    for _ in range(400):
        w = like * theta
        theta = ((w / w.sum(1, keepdims=True)).sum(0) + 0.5) / (4000 + 12.5)
    assert np.abs(sampling.gibbs_collapsed(rows, 20, 8) - theta).max() < 0.03
