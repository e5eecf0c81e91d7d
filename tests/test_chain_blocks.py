"""Chains whose blocks are stepped side by side: rows read once, whole sites as rows, blocks shared by models, prices by blocks."""

import numpy as np
from pyspark.sql import functions as F

from treeline.kernels import hmm
from treeline.operators import chains, path_search


def counted(rows):
    """The rows, and how many of them have been computed so far."""
    seen = rows.sparkSession.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    return rows.mapInPandas(run, rows.schema), seen


def wide(spark, emissions):
    rows = [(c, 3 + t, [float(x) if np.isfinite(x) else None for x in v]) for c, e in emissions.items() for t, v in enumerate(e)]
    return spark.createDataFrame(rows, "chain long, site long, v array<double>").repartition(3)


def test_f18_paths_of_many_short_chains(spark):
    """Chains of 1 to 40 sites with ties and impossible states, a row to a site; the rows are read once."""
    rng = np.random.default_rng(18)
    emissions = {c: rng.integers(-3, 1, (int(rng.integers(1, 41)), 4)).astype(float) for c in range(60)}
    emissions[7][0, :3] = -np.inf
    model = chains.switch_model(4, 2)
    rows, seen = counted(wide(spark, emissions))
    got = chains.Chains(rows, ["chain"], {0: model}, values="v", block=8, fan=2).paths().toPandas()
    assert seen.value == sum(map(len, emissions.values()))
    for c, e in emissions.items():
        own = got[got.chain == c].sort_values("site")
        assert own.site.tolist() == list(range(3, 3 + len(e))) and own.state.tolist() == hmm.decode(e, *model)["path"].tolist()


def test_f27_weights_read_the_rows_once(spark):
    """All rates and steps share the blocks of one reading."""
    e = np.random.default_rng(27).normal(size=(70, 3)) * 2
    rows = spark.createDataFrame([(t + 5, s, float(e[t, s])) for t in range(70) for s in range(3)], "site long, state int, value double")
    rows, seen = counted(rows)
    w, totals, _ = chains.fit_resets(rows, 3, [2.0, 9.0], steps=2, block=16, fan=4)
    assert seen.value == 210
    for r, x in enumerate((2.0, 9.0)):
        want, fit = hmm.fit_reset(e, x / 70, steps=2)
        assert np.allclose(w[r], want) and np.isclose(totals[r], fit["logl"])


def test_f19_prices_by_blocks_are_those_by_rows(spark):
    """Blocks of one, some and all sites; the values of a site are codes from which costs are made."""
    rng = np.random.default_rng(19)
    n, k = 45, 3
    codes = rng.integers(0, 6, (n, k)).astype(float)
    moved = np.array([[1.0, 2.0, 2.0], [2.0, 1.0, 3.0]])
    price = np.where(np.eye(k, dtype=bool), 0.0, -5.0)
    rows = spark.createDataFrame([(t + 7, [int(x) for x in codes[t]]) for t in range(n)], "site long, v array<int>")
    rows, seen = counted(rows)
    costs = lambda v: np.stack([(v[:, 0] * 3 + v[:, 1]) % 5, np.where(v[:, 2] > 3, 0.0, 7.0)], 1)
    for block in (1, 8, 64):
        before = seen.value
        found = chains.Chains(rows, [], {0: (np.zeros(k), price)}, values="v", emit=lambda v: -v.astype(float), block=block, fan=4)
        got = {r["candidate"]: r["cost"] for r in found.intervals(costs, 4.0 + moved).collect()}
        assert seen.value - before == n
        margins = found.margins().select("site", *[F.transform(x, lambda v: -v).alias(x) for x in ("upto", "onward")])
        scores = spark.createDataFrame([(c, t + 7, float(x)) for t, v in enumerate(costs(codes)) for c, x in enumerate(v)], "candidate int, site long, score double")
        want = {r["candidate"]: -r["gain"] for r in path_search.interval_prices(margins, scores, dict(enumerate(moved.tolist())), {0: 0.0, 1: 0.0}, 0.0, 4.0, 1.0).collect()}
        assert got == want


def test_f25_trees_of_partitions_from_one_reading(spark, sf_dir):
    """Trees and frequencies from patterns are those of each partition's own sites; the query reads its lines once."""
    from treeline.operators import alignment as A
    from treeline.operators import site_models as X
    from treeline.plans import site_model_queries as Q

    rng = np.random.default_rng(25)
    cells = [(t, s, None if rng.random() < 0.2 else int(rng.integers(0, 4) if rng.random() < 0.5 else s % 4)) for t in range(5) for s in range(1, 301) if rng.random() > 0.1]
    aln, seen = counted(spark.createDataFrame(cells, "taxon int, site int, base int"))
    where = spark.createDataFrame([(s, 2 * (s % 3)) for s in range(1, 281)], "site int, partition int")
    sites = X.kept(A.patterns(aln, 5)[0])
    weighted = X.kept(X.partition_patterns(sites.join(where, "site")))
    trees, pi = X.joined_trees(weighted, 5), X.pattern_frequencies(sites)
    assert seen.value == len(cells)
    assert trees == {p: X.joined_tree(aln.join(where.filter(F.col("partition") == p).select("site"), "site"), 5) for p in (0, 2, 4)}
    want = {r["base"]: r["frequency"] for r in A.base_frequencies(aln).collect()}
    assert np.allclose(pi, [want[b] for b in range(4)])
    lines, seen = counted(Q.relation(spark, sf_dir, "aln"))
    other, Q.relation = Q.relation, lambda s, d, name: lines if name == "aln" else other(s, d, name)
    try:
        linked, _ = Q._linked(spark, sf_dir)
        linked.evaluate(np.full(linked.n, 0.5))
    finally:
        Q.relation = other
    assert seen.value == lines.count() > 0
