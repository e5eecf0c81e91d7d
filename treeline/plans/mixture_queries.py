"""Queries over likelihood tables and grids; the flagship is here."""

from __future__ import annotations

from ..operators import grids as G
from ..operators import mixtures as M
from ..relations import lik_sites
from .helpers import F, oracle, query, relation, rounded

_N = """n0 AS MATERIALIZED (SELECT site, category, e / SUM(e) OVER (PARTITION BY site) AS l FROM (SELECT site, category, exp(logl - MAX(logl) OVER (PARTITION BY site)) AS e FROM lik))"""


def _em(steps: int) -> str:
    parts = [_N, "t0 AS (SELECT category, 1.0::DOUBLE / 25 AS theta FROM (SELECT DISTINCT category FROM n0))"]
    for k in range(steps):
        parts.append(f"""t{k + 1} AS MATERIALIZED (SELECT category, (SUM(r) + 0.5) / (SUM(SUM(r)) OVER () + 0.5 * COUNT(*) OVER ()) AS theta FROM (
            SELECT category, l * theta / SUM(l * theta) OVER (PARTITION BY site) AS r FROM n0 JOIN t{k} USING (category)) GROUP BY category)""")
    parts.append(f"post AS MATERIALIZED (SELECT site, category, l * theta / SUM(l * theta) OVER (PARTITION BY site) AS mass FROM n0 JOIN t{steps} USING (category))")
    return ", ".join(parts)


def _cells(spark, sf):
    """Normalised cells, those of a site in one array."""
    return M.normalise_packed(lik_sites(spark, sf))


def _posterior(spark, sf, steps: int = 5):
    packed = _cells(spark, sf)
    return M.posterior_packed(packed, M.em_packed(packed, steps))


@query("flagship_site_selection", oracle(f"""WITH {_em(5)}, s AS (SELECT site, COALESCE(SUM(mass) FILTER (beta > alpha), 0) AS p, COALESCE(SUM(mass) FILTER (beta < alpha), 0) AS q, SUM(mass * alpha) AS a, SUM(mass * beta) AS b
      FROM post JOIN grid USING (category) GROUP BY site)
    SELECT site, round(p, 6) AS p_positive, round(q, 6) AS p_purifying, round(a, 6) AS mean_alpha, round(b, 6) AS mean_beta,
      CASE WHEN p > 0.9 THEN 'positive' WHEN q > 0.9 THEN 'purifying' ELSE 'neutral' END AS selection FROM s"""))
def site_selection(spark, sf):
    return rounded(M.selection_table(_posterior(spark, sf), relation(spark, sf, "grid")))


@query("lik_max_shift", oracle("SELECT site, category, round(exp(logl - MAX(logl) OVER (PARTITION BY site)), 6) AS l FROM lik"))
def shift(spark, sf):
    return rounded(M.max_shift(relation(spark, sf, "lik")))


@query("lik_normalised", oracle(f"WITH {_N} SELECT site, category, round(l, 6) AS l FROM n0"))
def normalised(spark, sf):
    return rounded(_cells(spark, sf).select("site", F.posexplode("l").alias("category", "l")))


@query("lik_sparse_counts", oracle(f"WITH {_N} SELECT site, COUNT(*) AS kept FROM n0 WHERE l >= 0.01 GROUP BY site"))
def sparse(spark, sf):
    return M.sparsify(M.normalise(M.max_shift(relation(spark, sf, "lik"))), 0.01)[0].groupBy("site").agg(F.count(F.lit(1)).alias("kept"))


@query("em_weights", oracle(f"WITH {_em(5)} SELECT category, round(theta, 6) AS theta FROM t5"))
def weights(spark, sf):
    return rounded(M.em_packed(_cells(spark, sf), 5))


@query("posterior_mass", oracle(f"WITH {_em(3)} SELECT site, category, round(mass, 6) AS mass FROM post"))
def mass(spark, sf):
    return rounded(_posterior(spark, sf, 3))


@query("posterior_marginals", oracle(f"""WITH {_em(3)} SELECT site, 'alpha' AS axis, alpha_idx AS bin, round(SUM(mass), 6) AS mass FROM post JOIN grid USING (category) GROUP BY site, alpha_idx
    UNION ALL SELECT site, 'beta', beta_idx, round(SUM(mass), 6) FROM post JOIN grid USING (category) GROUP BY site, beta_idx"""))
def marginals(spark, sf):
    return rounded(M.marginals(_posterior(spark, sf, 3), relation(spark, sf, "grid")))


@query("posterior_expected_difference", oracle(f"WITH {_em(3)} SELECT site, round(SUM(mass * (beta - alpha)), 6) AS difference FROM post JOIN grid USING (category) GROUP BY site"))
def difference(spark, sf):
    return rounded(M.expectation(_posterior(spark, sf, 3), relation(spark, sf, "grid"), F.col("beta") - F.col("alpha"), "difference"))


@query("posterior_mean_dn", oracle(f"WITH {_em(3)} SELECT site, round(SUM(mass * alpha * beta), 6) AS dn FROM post JOIN grid USING (category) GROUP BY site"))
def mean_dn(spark, sf):
    return rounded(M.expectation(_posterior(spark, sf, 3), relation(spark, sf, "grid"), F.col("alpha") * F.col("beta"), "dn"))


@query("episodic_bayes_factor", oracle(f"""WITH {_em(3)}, s AS (SELECT site, COALESCE(SUM(mass) FILTER (beta > alpha), 0) AS p, SUM(mass * alpha) AS a FROM post JOIN grid USING (category) GROUP BY site)
    SELECT site, round(p, 6) AS p_positive, round(a, 6) AS mean_alpha, round((p / (1 - p)) / (0.4::DOUBLE / 0.6), 4) AS bayes_factor FROM s"""))
def episodic(spark, sf):
    found = M.episodic_table(_posterior(spark, sf, 3), relation(spark, sf, "grid"), 0.4)
    return rounded(found.withColumn("bayes_factor", F.round("bayes_factor", 4)))


@query("prior_mass_positive", oracle(f"WITH {_em(5)} SELECT round(SUM(theta) FILTER (beta > alpha), 6) AS positive, round(SUM(theta) FILTER (beta <= alpha), 6) AS other FROM t5 JOIN grid USING (category)"))
def prior_mass(spark, sf):
    t = M.em_packed(_cells(spark, sf), 5).join(relation(spark, sf, "grid"), "category")
    return rounded(t.agg(F.sum(F.when(F.col("beta") > F.col("alpha"), F.col("theta"))).alias("positive"), F.sum(F.when(F.col("beta") <= F.col("alpha"), F.col("theta"))).alias("other")))


@query("alpha_log_mean_exp", oracle("""SELECT site, beta_idx, round(MAX(t) + ln(avg(exp(logl - t))), 6) AS log_mean FROM (
    SELECT site, beta_idx, logl, MAX(logl) OVER (PARTITION BY site, beta_idx) AS t FROM lik JOIN grid USING (category)) GROUP BY site, beta_idx"""))
def alpha_collapse(spark, sf):
    rows = relation(spark, sf, "lik").join(F.broadcast(relation(spark, sf, "grid")), "category")
    return rounded(M.log_mean_exp(rows, ["site", "beta_idx"], "logl"))


@query("candidate_objective", oracle("""WITH m AS (SELECT site, beta_idx, MAX(t) + ln(avg(exp(logl - t))) AS v FROM (SELECT site, beta_idx, logl, MAX(logl) OVER (PARTITION BY site, beta_idx) AS t FROM lik JOIN grid USING (category)) GROUP BY site, beta_idx)
    SELECT beta_idx, round(SUM(v), 4) AS objective FROM m GROUP BY beta_idx"""))
def objective(spark, sf):
    rows = relation(spark, sf, "lik").join(F.broadcast(relation(spark, sf, "grid")), "category")
    return M.log_mean_exp(rows, ["site", "beta_idx"], "logl").groupBy("beta_idx").agg(F.round(F.sum("log_mean"), 4).alias("objective"))


_SHIFT = "h AS (SELECT site, (category // 5)::INT AS branch, category % 5 AS k, logl, (1 + category % 5)::DOUBLE / 75 AS prior FROM lik)"


@query("shift_burden", oracle(f"""WITH {_SHIFT}, j AS (SELECT *, logl + ln(prior) AS x FROM h), t AS (SELECT site, MAX(top) + ln(SUM(exp(x - top))) AS log_bf FROM (SELECT site, x, MAX(x) OVER (PARTITION BY site) AS top FROM j) GROUP BY site),
    b AS (SELECT site, branch, k, row_number() OVER (PARTITION BY site ORDER BY x DESC, branch, k) AS r FROM j)
    SELECT site, round(log_bf, 6) AS log_bf, branch AS map_branch, k AS map_k FROM t JOIN b USING (site) WHERE r = 1"""))
def shift_burden(spark, sf):
    return rounded(M.burden(_shift_rows(spark, sf)))


@query("shift_sites_per_branch", oracle(f"""WITH {_SHIFT}, w AS (SELECT site, branch, exp(x - MAX(x) OVER (PARTITION BY site)) AS w FROM (SELECT *, logl + ln(prior) AS x FROM h))
    SELECT branch, round(SUM(p), 5) AS expected_sites FROM (SELECT branch, w / SUM(w) OVER (PARTITION BY site) AS p FROM w) GROUP BY branch"""))
def shift_branches(spark, sf):
    return rounded(M.sites_per_branch(_shift_rows(spark, sf)), 5)


def _shift_rows(spark, sf):
    lik = relation(spark, sf, "lik")
    return lik.select("site", F.expr("int(category div 5)").alias("branch"), (F.col("category") % 5).alias("k"), "logl", ((1 + F.col("category") % 5) / 75.0).alias("prior"))


@query("emission_relative", oracle("SELECT tree_id, site, round(logl, 6) AS logl, round(logl - MAX(logl) OVER (PARTITION BY site), 6) AS relative FROM emission"))
def emission_relative(spark, sf):
    return rounded(M.emission_normalise(relation(spark, sf, "emission")))


@query("emission_argmax_path", oracle("SELECT site, (SELECT 0) + arg_max(tree_id, (logl, -tree_id)) AS state FROM emission GROUP BY site"))
def argmax_path(spark, sf):
    return relation(spark, sf, "emission").groupBy("site").agg(F.max_by("tree_id", F.struct(F.col("logl"), -F.col("tree_id"))).alias("state"))


@query("grid_axes", "SELECT (a * 5 + b)::INT AS category, a AS alpha_idx, b AS beta_idx, round(greatest(power(10.0::DOUBLE, -1.3010299956639813 + a * 0.6505149978319906) - 0.05, 0), 6) AS alpha, round(greatest(power(10.0::DOUBLE, -1.3010299956639813 + b * 0.6505149978319906) - 0.05, 0), 6) AS beta FROM (SELECT unnest(range(5))::INT AS a) CROSS JOIN (SELECT unnest(range(5))::INT AS b)")
def grid_axes(spark, sf):
    return rounded(G.selection_grid(spark, 5))


@query("grid_differential", "SELECT (a * 16 + b * 4 + c)::INT AS category, a AS alpha_idx, [0.1, 0.5, 1.0, 2.0][a + 1]::DOUBLE AS alpha, b AS omega1_idx, [0.1, 0.5, 1.0, 3.0][b + 1]::DOUBLE AS omega1, c AS omega2_idx, [0.1, 0.5, 1.0, 3.0][c + 1]::DOUBLE AS omega2 FROM (SELECT unnest(range(4))::INT AS a), (SELECT unnest(range(4))::INT AS b), (SELECT unnest(range(4))::INT AS c)")
def grid_differential(spark, sf):
    return G.differential_grid(spark, [0.1, 0.5, 1.0, 2.0], [0.1, 0.5, 1.0, 3.0])


@query("grid_episodic", "SELECT (a * 6 + b * 3 + c)::INT AS category, a AS alpha_idx, [0.5, 1.0][a + 1]::DOUBLE AS alpha, b AS omega1_idx, [0.0, 1.0][b + 1]::DOUBLE AS omega1, c AS omega2_idx, [0.5, 2.0, 8.0][c + 1]::DOUBLE AS omega2 FROM (SELECT unnest(range(2))::INT AS a), (SELECT unnest(range(2))::INT AS b), (SELECT unnest(range(3))::INT AS c)")
def grid_episodic(spark, sf):
    return G.episodic_grid(spark, [0.5, 1.0], [0.0, 1.0, 2.0], [0.5, 2.0, 8.0])


@query("grid_shift", oracle("SELECT category, alpha_idx, beta_idx, round(alpha, 6) AS alpha, round(beta, 6) AS beta, k_idx, [1.0, 2.0, 4.0][k_idx + 1]::DOUBLE AS k FROM grid CROSS JOIN (SELECT unnest(range(3))::INT AS k_idx)"))
def grid_shift(spark, sf):
    return rounded(G.shift_grid(relation(spark, sf, "grid"), [2.0, 4.0]))


@query("quadrature_integral", "SELECT round(ln(2.0::DOUBLE), 6) AS integral, round(1.0::DOUBLE, 6) AS total")
def quadrature(spark, sf):
    return rounded(G.quadrature_table(spark, 24).agg(F.sum(F.col("w") / (1 + F.col("x"))).alias("integral"), F.sum("w").alias("total")))


@query("activation_integral", oracle("""WITH e AS (SELECT site % 10 AS edge, avg(exp(logl / 10)) AS r FROM lik GROUP BY 1) SELECT edge, round(ln((1 + r) / 2), 6) AS log_mean FROM e"""))
def activation(spark, sf):
    """log of the mean over the activation weight x of (1 - x) + x r, by quadrature."""
    edges = relation(spark, sf, "lik").groupBy((F.col("site") % 10).alias("edge")).agg(F.avg(F.exp(F.col("logl") / 10)).alias("r"))
    nodes = edges.crossJoin(F.broadcast(G.quadrature_table(spark, 24)))
    return rounded(nodes.groupBy("edge").agg(F.ln(F.sum(F.col("w") * (1 - F.col("x") + F.col("x") * F.col("r")))).alias("log_mean")))


@query("gibbs_weights", oracle("SELECT category, true AS dense, true AS sparse, true AS collapsed FROM grid"))
def gibbs_weights(spark, sf):
    """Weights of every category by three samplers over all sites: within the sampling error of those of EM, which is an oracle's of its own."""
    from ..operators import sampling as P

    packed = _cells(spark, sf)
    sites = packed.count()
    em = {r["category"]: r["theta"] for r in M.em_packed(packed, 30).collect()}
    found = [P.gibbs(packed, 30, 10)[0], P.gibbs(P.sparse(packed, 1e-4), 30, 10)[0], P.gibbs_collapsed(packed, 20, 8)]
    near = lambda theta, c: bool(abs(theta[c] - em[c]) < 0.03 + 6 * (max(em[c], 1 / sites) / sites) ** 0.5)
    return spark.createDataFrame([(c, *[near(x, c) for x in found]) for c in sorted(em)], "category int, dense boolean, sparse boolean, collapsed boolean")
