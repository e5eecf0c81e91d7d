"""What only larger tables show: numbers that outgrow their type or their column, merged variances, many draws."""

import numpy as np
from pyspark.sql import functions as F

from treeline.functions.scalars import combination_rank
from treeline.kernels import align, codon, inference
from treeline.operators import analyses, compare, triplets
from treeline.plans import registry
from treeline.sources.parsers import parse_newick

codon_init = codon.Operators.__init__


def test_equal_values_of_many_partitions_have_no_correlation(spark):
    # a partial mean of 49 ones, merged into an empty one, is not 1
    rows = spark.range(0, 49 * 6, 1, 6).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), (F.col("id") * 2.0).alias("z"))
    got = rows.agg(compare.pearson("x", "y").alias("flat"), compare.pearson("x", "z").alias("line")).first()
    assert got["flat"] is None and abs(got["line"] - 1) < 1e-12


def test_ranks_of_many_taxa(spark):
    n = 200_000
    rows = spark.createDataFrame([(0, 1, 2), (n - 3, n - 2, n - 1)], "a int, b int, c int")
    got = [r[0] for r in rows.select(combination_rank(F.col("a"), F.col("b"), F.col("c"), F.lit(n))).collect()]
    assert got == [0, n * (n - 1) * (n - 2) // 6 - 1]
    assert triplets.plan(spark, 1500, 10).select(F.explode(F.array(F.array("a", "b"), F.array("a", "c"), F.array("b", "c")))).distinct().count() == 1500 * 1499 // 2


def test_gamma_draws_of_many_are_those_of_one():
    p = np.concatenate([np.random.default_rng(1).random(200), [0.0, 1e-9, 1 - 1e-12]])
    for shape in (0.05, 0.8, 7.0, 150.0):
        assert np.allclose(inference.gamma_quantiles(p, shape), [inference.gamma_quantile(x, shape) * shape for x in p], rtol=1e-13, atol=0)


def test_residues_of_more_than_four_digits(spark, sf_dir, tmp_path):
    rows = [("BUILDING" if k % 3 else "AUTO", k, k % 25) for k in [*range(9990, 10010), 19998, 123456]]
    spark.createDataFrame(rows, "c_mktsegment string, c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("pdb_scan", "mmcif_scan"):
        got = registry.queries()[name](spark, str(tmp_path)).toPandas().sort_values(["path", "ordinal"])
        for path in ("AUTO", "BUILDING"):
            keys = sorted(k for s, k, _ in rows if s == path)
            mine = got[got["path"] == path]
            assert mine["number"].tolist() == [k + 1 for k in keys] and mine["ordinal"].tolist() == list(range(len(keys)))


def test_local_alignment_in_rows_is_that_of_the_matrix():
    rng = np.random.default_rng(3)
    for t in range(60):
        n, m = (int(x) for x in rng.integers(1, 45, 2))
        s = rng.integers(-4, 7, (n, m)).astype(float) if t % 2 else rng.normal(0.2, 3, (n, m))
        gaps = [(-10, -0.5), (-3, -0.5), (-2, -1)][t % 3]
        score, pairs = align.align(s, *gaps, local=True)
        got, extent = align.local_extent(n, s.__getitem__, m, *gaps)
        assert abs(got - score) < 1e-9 and extent == len(pairs)


def test_profiles_of_more_cells_than_a_matrix_holds(spark):
    n = 10_050  # align refuses 100 million cells
    letters = "ARND" * (n // 4 + 1)
    profile = spark.range(n).select(F.lit("p").alias("profile"), F.col("id").alias("codon_site"), F.element_at(F.array(*[F.lit(c) for c in "ARND"]), (F.col("id") % 4 + 1).cast("int")).alias("aa"), F.lit(1.0).alias("frequency"))
    chains = spark.createDataFrame([("c", letters[:n])], "chain string, residues string")
    got = analyses.align_profiles(profile, chains).first()
    assert got["pairs"] == n and got["score"] == sum(map((4.0, 5.0, 6.0, 6.0).__getitem__, (k % 4 for k in range(n))))


def test_likelihood_ratios_of_many_sites_are_those_of_one():
    rng = np.random.default_rng(1)
    x, rates = np.arange(6), np.array([0.0, 0.2, 0.5, 1.0, 3.0, 9.0])
    top, width = rng.uniform(-1, 7, (40, 2)), rng.uniform(0.01, 2, (40, 2))
    surfaces = np.array([-w[0] * (x[:, None] - t[0]) ** 2 - w[1] * (x[None, :] - t[1]) ** 2 for t, w in zip(top, width, strict=True)]) + rng.normal(0, 0.05, (40, 6, 6))
    got = inference.approximate_fels(surfaces, rates, rates)
    for k, one in enumerate(inference.approximate_fel(z, rates, rates) for z in surfaces):
        assert all(np.isclose(got[c][k], one[c], rtol=1e-12, atol=1e-12) for c in one)


def test_blocks_of_patterns_share_their_eigensystems(monkeypatch):
    made = []
    monkeypatch.setattr(codon, "Operators", type("Counted", (codon.Operators,), {"__init__": lambda self, *x: (made.append(1), codon_init(self, *x))[1]}))
    tree, model = codon.Tree(parse_newick("((t0:0.1,t1:0.2):0.1,t2:0.3);")), codon.CodonModel(np.ones(6), np.full((3, 4), 0.25))
    a = b = np.array([0.5, 1.0, 2.0])
    states, banks = np.random.default_rng(2).integers(-1, 61, (3, 20)), {}
    parts = [codon.grid_likelihood(tree, model, states[:, lo : lo + 5], a, b, 2, banks) for lo in range(0, 20, 5)]
    assert len(made) == 2 and np.allclose(np.concatenate(parts, 1), codon.grid_likelihood(tree, model, states, a, b, 2))
