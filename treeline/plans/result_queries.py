"""Queries of result tables, branch mixtures, settings of simulations, and costs and weights of chains."""

from __future__ import annotations

from ..operators import branch_mixtures as B
from ..operators import grids as G
from ..operators import mixtures as M
from ..operators import signals as Z
from ..operators import simulation as S
from ..operators import tables as P
from .helpers import F, oracle, query, relation, rounded, table
from .mixture_queries import _em, _posterior

_SITES = "s AS (SELECT site, COALESCE(SUM(mass) FILTER (beta > alpha), 0) AS p, COALESCE(SUM(mass) FILTER (beta < alpha), 0) AS q, SUM(mass * alpha) AS a, SUM(mass * beta) AS b FROM post JOIN grid USING (category) GROUP BY site)"


@query("selection_report", oracle(f"""WITH {_em(3)}, {_SITES} SELECT site AS "Codon Sites", round(p, 6) AS "P(beta > alpha)", round(q, 6) AS "P(alpha > beta)", round(a, 6) AS "mean(alpha)", round(b, 6) AS "mean(beta)",
    p > 0.5 AS positive_selected, q > 0.5 AS purifying_selected, CASE WHEN p > 0.5 THEN 'positive' WHEN q > 0.5 THEN 'purifying' ELSE 'none' END AS selection FROM s"""))
def selection_report(spark, sf):
    report = P.selection_report(M.selection_table(_posterior(spark, sf, 3), relation(spark, sf, "grid")), 0.5)
    return report.select(*[F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in report.dtypes])


@query("ratio_report", oracle("SELECT site, round(score, 6) AS p_positive, round(p, 6) AS p_purifying, 0.1::DOUBLE AS significance_threshold, COALESCE(score <= 0.1, false) AS positive_selected_at_threshold, COALESCE(p <= 0.1, false) AS purifying_selected_at_threshold FROM truth"))
def ratio_report(spark, sf):
    rows = relation(spark, sf, "truth").select("site", F.col("score").alias("p_positive"), F.col("p").alias("p_purifying"))
    return rounded(P.ratio_report(rows, 0.1))


@query("violin_lanes", oracle(f"""WITH {_em(3)}, {_SITES}, c AS (SELECT site, CASE WHEN p > 0.5 THEN 'positive' ELSE 'purifying' END AS call FROM s WHERE p > 0.5 OR q > 0.5),
    m AS (SELECT site, 'alpha' AS axis, alpha_idx AS bin, SUM(mass) AS mass FROM post JOIN grid USING (category) GROUP BY site, alpha_idx UNION ALL SELECT site, 'beta', beta_idx, SUM(mass) FROM post JOIN grid USING (category) GROUP BY site, beta_idx)
    SELECT site, call, axis, bin, round(mass, 6) AS mass FROM c JOIN m USING (site)"""))
def violin_lanes(spark, sf):
    grid = relation(spark, sf, "grid")
    post = _posterior(spark, sf, 3)
    rows = P.violin_rows(M.marginals(post, grid), M.selection_table(post, grid), 0.5)
    lanes = rows.select("site", "call", F.explode(F.create_map(F.lit("alpha"), "alpha", F.lit("beta"), "beta")).alias("axis", "lane"))
    return rounded(lanes.select("site", "call", "axis", F.posexplode("lane").alias("bin", "mass")))


@query("json_rows", "SELECT '{\"key\":' || o_orderkey || ',\"values\":[' || o_custkey || ',null],\"named\":{\"' || o_orderstatus || '\":' || o_custkey || '}}' AS json FROM orders")
def json_rows(spark, sf):
    o = table(spark, sf, "orders")
    return P.plain_json(o.select(F.col("o_orderkey").alias("key"), F.array("o_custkey", F.lit(None)).alias("values"), F.create_map("o_orderstatus", "o_custkey").alias("named")))


@query("newick_found", oracle("""WITH r AS (SELECT * , row_number() OVER (PARTITION BY tree_id ORDER BY start) AS i FROM region_runs)
    SELECT 'result.regions.' || i || '.newick' AS label, '(' || start || ',' || tree_id || ');' AS tree FROM r UNION ALL SELECT 'names.' || tree_id, '(' || tree_id || ');' FROM (SELECT DISTINCT tree_id FROM region_runs)"""))
def newick_found(spark, sf):
    region = F.struct("start", F.concat(F.lit(" ("), "start", F.lit(","), "tree_id", F.lit("); ")).alias("newick"), F.lit("(no tree)").alias("note"))
    nested = relation(spark, sf, "region_runs").groupBy("tree_id").agg(F.struct(F.array_sort(F.collect_list(region)).alias("regions")).alias("result"))
    return P.newick_texts(nested.select("result", F.create_map("tree_id", F.concat(F.lit("("), "tree_id", F.lit(");"))).alias("names")))


@query("nested_rows", oracle("SELECT row_number() OVER (PARTITION BY tree_id ORDER BY start)::INT AS row, start, \"end\" FROM region_runs"))
def nested_rows(spark, sf):
    nested = relation(spark, sf, "region_runs").groupBy("tree_id").agg(F.struct(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("regions")).alias("result"))
    return P.nested_tables(nested)["result.regions"]


@query("restored_names", "SELECT r_name AS tree_id, '(' || string_agg(n_name || ':0.' || n_nationkey, ',' ORDER BY n_nationkey) || ');' AS newick FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def restored_names(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tip = F.struct("n_nationkey", F.concat("n_nationkey", F.lit(":0."), "n_nationkey").alias("t"))
    text = F.concat(F.lit("("), F.array_join(F.transform(F.array_sort(F.collect_list(tip)), lambda x: x["t"]), ","), F.lit(");"))
    return P.restored_names(n.groupBy(F.col("r_name").alias("tree_id")).agg(text.alias("newick")), n.select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("name")))


@query("null_vector", "SELECT n_regionkey AS model, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS position, n_name AS name, n_nationkey / 10.0::DOUBLE AS value FROM nation WHERE n_name <> 'NATION_7'")
def null_vector(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("model"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("name"), (F.col("n_nationkey") / 10.0).alias("value"))
    return P.null_vector(n, "NATION_7")


@query("saved_index", oracle("SELECT dataset, source, method, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics, COUNT(DISTINCT key) AS keys FROM signal GROUP BY ALL"))
def saved_index(spark, sf):
    return P.saved_index(relation(spark, sf, "signal")).withColumn("metrics", F.array_join("metrics", ","))


_NODES = ", ".join(f"({k}, {x!r}::DOUBLE, {w!r}::DOUBLE)" for k, (x, w) in enumerate(zip(*G.quadrature(4), strict=True)))


@query("episodic_operators", f"""WITH g AS (SELECT (b * 3 + c)::INT AS category, [0.0, 1.0][b + 1]::DOUBLE AS u, [0.5, 1.0, 8.0][c + 1]::DOUBLE AS v FROM (SELECT unnest(range(2))::INT AS b), (SELECT unnest(range(3))::INT AS c)), q(node, x, w) AS (VALUES {_NODES})
    SELECT category, node, 0.5::DOUBLE AS scale, round(w, 6) AS collapse, u AS omega, round(CASE WHEN u = v THEN 1 ELSE x END, 6) AS weight FROM g, q UNION ALL SELECT category, node, 0.5::DOUBLE, round(w, 6), v, round(1 - x, 6) FROM g, q WHERE u <> v""")
def episodic_operators(spark, sf):
    return rounded(B.episodic_operators(G.episodic_grid(spark, [0.5], [0.0, 1.0], [0.5, 1.0, 8.0]), 4))


@query("gamma_operators", """WITH e AS (SELECT i, 1.0::DOUBLE - i / 8.0::DOUBLE AS s FROM (SELECT unnest(range(9)) AS i)), p AS (SELECT i, 1 - CASE WHEN s > 0 THEN (1 - ln(s)) * s ELSE 0 END AS p FROM e),
    o AS (SELECT a.i, 8 * (b.p - a.p) AS unit FROM p a JOIN p b ON b.i = a.i + 1), g AS (SELECT n_nationkey AS category, (1 + n_regionkey) / 2.0::DOUBLE AS scale, (1 + n_nationkey % 3) / 2.0::DOUBLE AS mean, n_nationkey % 2 = 1 AS capped FROM nation)
    SELECT category, scale, omega, COUNT(*) / 8.0::DOUBLE AS weight FROM (SELECT category, scale, round(CASE WHEN capped THEN least(mean * unit, 1) ELSE mean * unit END, 6) AS omega FROM g, o) GROUP BY ALL""")
def gamma_operators(spark, sf):
    n = table(spark, sf, "nation")
    grid = n.select(F.col("n_nationkey").alias("category"), ((1 + F.col("n_regionkey")) / 2.0).alias("alpha"), ((1 + F.col("n_nationkey") % 3) / 2.0).alias("mean"), F.lit(1.0).alias("shape"), (F.col("n_nationkey") % 2 == 1).alias("capped"))
    return rounded(B.gamma_operators(grid, 8))


_AXES = {k: str([float(v) for v in values]) for k, values in B.CANDIDATES["thorough"].items()}


@query("gamma_candidates", f"SELECT (i * 100 + j * 10 + k)::INT AS category, {_AXES['omega_mean']}[i + 1]::DOUBLE AS omega_mean, {_AXES['omega_shape']}[j + 1]::DOUBLE AS omega_shape, {_AXES['alpha_shape']}[k + 1]::DOUBLE AS alpha_shape FROM (SELECT unnest(range(11)) AS i), (SELECT unnest(range(10)) AS j), (SELECT unnest(range(10)) AS k)")
def gamma_candidates(spark, sf):
    return B.gamma_candidates(spark, "thorough")


@query("gamma_candidate_categories")
def candidate_categories(spark, sf):
    return rounded(B.candidate_categories(B.gamma_candidates(spark), 4, 8))


@query("directional_gap", oracle("""WITH c AS (SELECT tree_id AS mask, site AS boundary, round(-logl * 40)::BIGINT AS cost FROM emission), n AS (SELECT f.boundary, f.cost + b.cost + bit_count(xor(f.mask, b.mask)) * 1.5 AS cost FROM c f JOIN (SELECT mask, boundary - 1 AS boundary, cost FROM c) b USING (boundary) WHERE f.mask & 1 = 0 AND b.mask & 1 = 1)
    SELECT boundary, round(greatest(MIN(cost) - 20, 0), 6)::DOUBLE AS gap FROM n GROUP BY boundary"""))
def directional_gap(spark, sf):
    cost = relation(spark, sf, "emission").select(F.col("tree_id").alias("mask"), F.col("site").alias("boundary"), F.round(-F.col("logl") * 40).cast("long").alias("cost"))
    return rounded(Z.directional_gap(cost, cost.withColumn("boundary", F.col("boundary") - 1), 0, True, 1.5, 20.0))


@query("path_penalties", """WITH a AS (SELECT s_suppkey, (4 + s_suppkey % 9)::DOUBLE AS taxa, (100 + 37 * s_suppkey)::DOUBLE AS sites, CASE s_suppkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.25 END::DOUBLE AS given FROM supplier)
    SELECT s_suppkey, round(CASE WHEN given > 0 THEN given WHEN given = 0 THEN log2(sites + 1) ELSE 4 END, 6) AS breakpoint, round(CASE WHEN given > 0 THEN given WHEN given = 0 THEN greatest(1, log2(taxa) / 2) ELSE 1 END, 6) AS endpoint,
    round(CASE WHEN given > 0 THEN given WHEN given = 0 THEN 1 / greatest(80, greatest(16, round(greatest(64, least(250, sites / 8))))) ELSE 0.002 END, 6)::DOUBLE AS span FROM a""")
def path_penalties(spark, sf):
    s = F.col("s_suppkey")
    given = F.when(s % 3 == 0, 0.0).when(s % 3 == 1, 1.25)
    found = Z.path_penalties((4 + s % 9).cast("double"), (100 + 37 * s).cast("double"), {k: given for k in ("breakpoint", "endpoint", "span")}, F.lit(None).cast("double"))
    return rounded(table(spark, sf, "supplier").select("s_suppkey", *[c.alias(k) for k, c in found.items()]))


@query("simulation_settings", """WITH c AS (SELECT c_custkey, c_custkey % 2500 AS tips, c_custkey % 7 AS first, c_acctbal AS horizon, c_nationkey AS nation FROM customer), t AS (SELECT *, greatest(2, least(2000, tips)) AS kept FROM c)
    SELECT c_custkey, kept::INT AS tips, greatest(1, least(kept, first))::INT AS initial, round(greatest(0.1, horizon), 6) AS horizon, CASE WHEN nation % 2 = 0 THEN 'scuff' ELSE 'mg94' END AS engine,
    round(CASE WHEN nation % 2 = 0 THEN greatest(0, nation - 5.0) END, 6)::DOUBLE AS burnin, round(greatest(1, least(20, nation)), 6)::DOUBLE AS oversample, (2 * kept)::INT AS carrier_tips,
    CASE WHEN greatest(1, least(kept, first)) = kept THEN 2 * kept ELSE greatest(1, least(2 * kept, 2 * greatest(1, least(kept, first)))) END::INT AS carrier_initial FROM t""")
def simulation_settings(spark, sf):
    c = table(spark, sf, "customer")
    text = F.to_json(F.struct(
        F.struct((F.col("c_custkey") % 2500).alias("observedTips"), (F.col("c_custkey") % 7).cast("string").alias("initialTips"), F.col("c_acctbal").alias("horizon")).alias("tree"),
        F.struct(F.when(F.col("c_nationkey") % 2 == 0, "scuff").alias("engine"), (F.col("c_nationkey") - 5.0).alias("burninTime")).alias("codon"),
        F.struct(F.col("c_nationkey").alias("carrierOversample")).alias("recombination")))
    found = S.normalised(c.select("c_custkey", text.alias("config")))
    carrier = S.carrier_tree("tree", 2 * F.col("tree.observed_tips"))
    return rounded(found.withColumn("carrier", carrier).select(
        "c_custkey", F.col("tree.observed_tips").alias("tips"), F.col("tree.initial_tips").alias("initial"), "tree.horizon", "codon.engine", "codon.burnin", F.col("recombination.carrier_oversample").alias("oversample"),
        F.col("carrier.observed_tips").alias("carrier_tips"), F.col("carrier.initial_tips").alias("carrier_initial")))


@query("marginal_draws")
def marginal_draws(spark, sf):
    spec = F.struct(F.when(F.col("o_orderkey") % 2 == 0, "gamma").otherwise("fixed").alias("kind"), F.lit(0.55).alias("mean"), F.lit(0.8).alias("shape"))
    return rounded(table(spark, sf, "orders").select("o_orderkey", S.drawn(spec, F.col("o_orderkey")).alias("value")))


@query("emission_proxy_weights", oracle("""WITH e AS (SELECT tree_id, site, exp(greatest(-60, logl - MAX(logl) OVER (PARTITION BY site))) AS l FROM emission), r AS (SELECT tree_id, l / SUM(l) OVER (PARTITION BY site) AS r FROM e), w AS (SELECT tree_id, SUM(r) + 0.05 AS w FROM r GROUP BY tree_id)
    SELECT tree_id, round(w / SUM(w) OVER (), 6) AS weight FROM w"""))
def proxy_weights(spark, sf):
    return rounded(M.proxy_weights(relation(spark, sf, "emission"), "tree_id"))


@query("named_moves", "SELECT s_suppkey, list_aggregate(list_sort(['NATION_' || s_nationkey, 'NATION_' || (s_nationkey + 7) % 25]), 'string_agg', ',') AS moved, 'NATION_' || (s_suppkey % 25) AS target FROM supplier")
def named_moves(spark, sf):
    s, nation = table(spark, sf, "supplier"), table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("index"), F.col("n_name").alias("name"))
    one = lambda c: c.cast("int")
    moves = s.select("s_suppkey", F.array(one(F.col("s_nationkey")), one((F.col("s_nationkey") + 7) % 25)).alias("moved"), F.array(one(F.col("s_suppkey") % 25), F.lit(99)).alias("target"))
    found = P.named_moves(moves, nation)
    return found.select("s_suppkey", F.array_join("moved", ",").alias("moved"), F.array_join("target", ",").alias("target"))
