"""Selection from arrays that stay where they are: the same numbers as by rows of categories, and no such rows."""

import numpy as np
from pyspark.sql import functions as F

from treeline.operators import mixtures as M
from treeline.operators import site_models as X

NAMES = ["p_positive", "p_purifying", "mean_alpha", "mean_beta"]


def test_calls_of_held_arrays_are_those_of_rows_of_categories(spark):
    rng = np.random.default_rng(4)
    axis = np.array([0.1, 1.0, 4.0])
    a, b = (v.ravel() for v in np.meshgrid(axis, axis, indexing="ij"))
    l = rng.gamma(0.2, 1, (300, 9)) + 1e-9  # noqa: E741
    rows = [(f"p{k}", [float(y) for y in x / x.sum()], int(n)) for k, (x, n) in enumerate(zip(l, rng.integers(1, 9, 300), strict=True))]
    held = spark.createDataFrame(rows, "pattern string, l array<double>, n long").repartition(5)
    theta = M.em_held(held.select("l", "n"), 4, 0.5)
    want = M.em_packed(held.select("l", "n"), 4, 0.5, "n")
    assert np.allclose(theta, [r["theta"] for r in want.orderBy("category").collect()], rtol=1e-12)
    grid = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(a, b, strict=True))], "category int, alpha double, beta double")
    old = M.selection_table(M.posterior_packed(held.select(F.col("pattern").alias("site"), "l"), want), grid, 0.8).toPandas().sort_values("site")
    new = M.selection_held(held, theta, a, b, 0.8).toPandas().sort_values("pattern")
    assert np.allclose(new[NAMES], old[NAMES], rtol=0, atol=1e-12) and new["selection"].tolist() == old["selection"].tolist() and len(set(new["selection"])) == 3


def test_no_row_of_a_category_and_no_array_is_shuffled(spark, monkeypatch):
    tips = "((t0:0.1,t1:0.2):0.1,t2:0.3);"
    rows = [(t, s, "ATGGCTAAAGGT"[3 * ((s + t * s) % 4) :][:3]) for t in range(3) for s in range(1, 30)]
    codons = X.Codons(spark.createDataFrame(rows, "taxon int, codon_site int, codon string"), 3, X.Fitted(tips, [1.0] * 6, [[0.25] * 4] * 3))
    written = []
    monkeypatch.setattr(M, "kept", lambda df: written.append(df) or df)
    found = X.selection(codons, [0.2, 1.0, 3.0], steps=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and not written
    assert found.count() == 29 and found.columns == ["site", *NAMES, "selection", "lrt", "direction"]
