"""Queries of windows, rankings, sets, intervals and trees."""

from __future__ import annotations

from ..operators import intervals as I
from ..operators import ranking as R
from ..operators import trees as T
from ..operators import windows as W
from .helpers import F, oracle, query, relation, rounded, table

_ISLANDS = """m AS (SELECT chain, pos, state, SUM(c) OVER (PARTITION BY chain ORDER BY pos) AS run FROM (SELECT chain, pos, state, CASE WHEN lag(state) OVER w IS NOT DISTINCT FROM state AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c
    FROM events_chain WINDOW w AS (PARTITION BY chain ORDER BY pos)))"""


@query("chain_runs", oracle(f"WITH {_ISLANDS} SELECT chain, run::BIGINT AS run, state, MIN(pos) AS start, MAX(pos) AS \"end\", COUNT(*) AS length FROM m GROUP BY chain, run, state"))
def chain_runs(spark, sf):
    return W.runs(relation(spark, sf, "events_chain"), ["chain"], "pos", "state")


@query("chain_longest_run", oracle(f"WITH {_ISLANDS}, r AS (SELECT chain, run, state, MIN(pos) AS start, COUNT(*) AS length FROM m GROUP BY chain, run, state) SELECT chain, start, length FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY length DESC, start) AS k FROM r WHERE state = 2) WHERE k = 1"))
def longest_run(spark, sf):
    return W.longest_run(relation(spark, sf, "events_chain").withColumn("on", F.col("state") == 2), ["chain"], "pos", "on")


@query("chain_transition_counts", oracle("""SELECT state AS from_state, nxt AS to_state, COUNT(*) AS n, round((COUNT(*) + 0.5) / (SUM(COUNT(*)) OVER (PARTITION BY state) + 0.5 * COUNT(*) OVER (PARTITION BY state)), 6) AS rate FROM (
    SELECT state, lead(state) OVER (PARTITION BY chain ORDER BY pos) AS nxt FROM events_chain) WHERE nxt IS NOT NULL GROUP BY state, nxt"""))
def transitions(spark, sf):
    from pyspark.sql import Window

    nxt = F.lead("state").over(Window.partitionBy("chain").orderBy("pos"))
    n = relation(spark, sf, "events_chain").select(F.col("state").alias("from_state"), nxt.alias("to_state")).filter("to_state IS NOT NULL").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("from_state")
    return rounded(n.withColumn("rate", (F.col("n") + 0.5) / (F.sum("n").over(w) + 0.5 * F.count(F.lit(1)).over(w))))


@query("chain_emission_accuracy", oracle("""WITH n AS (SELECT chain, (pos - 1) // 10 AS segment, state, COUNT(*) AS n FROM events_chain GROUP BY ALL), b AS (SELECT chain, segment, MAX(n) AS most, SUM(n) AS total FROM n GROUP BY ALL)
    SELECT chain, round(least(greatest((SUM(most) + 0.5) / (SUM(total) + 1.5), 0.34), 0.995), 6) AS accuracy FROM b GROUP BY chain"""))
def emission_accuracy(spark, sf):
    chain = relation(spark, sf, "events_chain").withColumn("segment", F.expr("(pos - 1) div 10"))
    return rounded(W.emission_accuracy(chain, ["chain"], "segment", "state"))


_SIG = "s AS (SELECT dataset, metric, key, value FROM signal WHERE metric = 'p_value')"


@query("signal_average_ranks", oracle(f"WITH {_SIG} SELECT dataset, key, rank() OVER (PARTITION BY dataset ORDER BY value) + (COUNT(*) OVER (PARTITION BY dataset, value) - 1) / 2.0::DOUBLE AS rank FROM s"))
def average_ranks(spark, sf):
    return W.average_ranks(relation(spark, sf, "signal").filter("metric = 'p_value'"), ["dataset"], "value").select("dataset", "key", "rank")


@query("signal_holm", oracle(f"""WITH {_SIG}, r AS (SELECT dataset, key, value, least(1.0, (COUNT(*) OVER (PARTITION BY dataset) - row_number() OVER (PARTITION BY dataset ORDER BY value, key) + 1) * value) AS x FROM s)
    SELECT dataset, key, round(MAX(x) OVER (PARTITION BY dataset ORDER BY value, key ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM r"""))
def holm(spark, sf):
    return rounded(W.holm(relation(spark, sf, "signal").filter("metric = 'p_value'"), ["dataset"], "value", "key").select("dataset", "key", "adjusted"))


@query("emission_weighted_median", oracle("SELECT tree_id, MIN(site) AS median FROM (SELECT tree_id, site, SUM(w) OVER (PARTITION BY tree_id ORDER BY site) AS r, SUM(w) OVER (PARTITION BY tree_id) AS t FROM (SELECT tree_id, site, round(-logl * 40)::BIGINT AS w FROM emission)) WHERE 2 * r >= t GROUP BY tree_id"))
def weighted_median(spark, sf):
    rows = relation(spark, sf, "emission").withColumn("w", F.round(-F.col("logl") * 40).cast("long"))
    return W.weighted_median(rows, ["tree_id"], "site", "w")


@query("emission_weighted_quantile", oracle("SELECT tree_id, MIN(site) AS quantile FROM (SELECT tree_id, site, SUM(w) OVER (PARTITION BY tree_id ORDER BY site) AS r, SUM(w) OVER (PARTITION BY tree_id) AS t FROM (SELECT tree_id, site, round(-logl * 40)::BIGINT AS w FROM emission)) WHERE r >= 0.25 * t GROUP BY tree_id"))
def weighted_quantile(spark, sf):
    rows = relation(spark, sf, "emission").withColumn("w", F.round(-F.col("logl") * 40).cast("long"))
    return W.weighted_quantile(rows, ["tree_id"], "site", "w", 0.25)


@query("emission_best_interval", oracle("""WITH g AS (SELECT tree_id, site, round(-logl * 40)::BIGINT - 48 AS g FROM emission), p AS (SELECT tree_id, site, SUM(g) OVER w AS p, row_number() OVER w AS n FROM g WINDOW w AS (PARTITION BY tree_id ORDER BY site)),
    m AS (SELECT tree_id, site, n, p - least(COALESCE(MIN(p) OVER (PARTITION BY tree_id ORDER BY site ROWS BETWEEN UNBOUNDED PRECEDING AND 10 PRECEDING), 0), 0) AS gain FROM p)
    SELECT tree_id, gain::DOUBLE AS gain, site AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY gain DESC, site) AS k FROM m WHERE n >= 10) WHERE k = 1"""))
def best_interval(spark, sf):
    rows = relation(spark, sf, "emission").withColumn("g", (F.round(-F.col("logl") * 40).cast("long") - 48).cast("double"))
    return W.best_interval_gain(rows, ["tree_id"], "site", "g", 10)


@query("boundary_gap", oracle("""WITH c AS (SELECT tree_id AS state, site AS boundary, round(-logl * 40)::BIGINT AS cost FROM emission), n AS (SELECT f.boundary, f.state = b.state AS stay, f.cost + b.cost AS cost FROM c f JOIN (SELECT state, boundary - 1 AS boundary, cost FROM c) b USING (boundary))
    SELECT boundary, stay, change, change - stay AS gap FROM (SELECT boundary, MIN(cost) FILTER (stay) AS stay, MIN(cost) FILTER (NOT stay) AS change FROM n GROUP BY boundary)"""))
def boundary_gap(spark, sf):
    cost = relation(spark, sf, "emission").select(F.col("tree_id").alias("state"), F.col("site").alias("boundary"), F.round(-F.col("logl") * 40).cast("long").alias("cost"))
    return W.boundary_gap(cost, cost.withColumn("boundary", F.col("boundary") - 1))


@query("endpoint_interval", oracle("""WITH v AS (SELECT tree_id, site, round(logl * 40)::BIGINT AS v FROM emission), b AS (SELECT tree_id, MAX(v) AS best FROM v GROUP BY tree_id), a AS (SELECT tree_id, MIN(site) AS best_at FROM v JOIN b USING (tree_id) WHERE v = best GROUP BY tree_id),
    n AS (SELECT tree_id, site, v >= best - 30 AS near FROM v JOIN b USING (tree_id)), r AS (SELECT *, site - row_number() OVER (PARTITION BY tree_id ORDER BY site) AS isle FROM n WHERE near),
    i AS (SELECT tree_id, MIN(site) AS start, MAX(site) AS "end" FROM r GROUP BY tree_id, isle) SELECT tree_id, best_at AS best, start, "end" FROM i JOIN a USING (tree_id) WHERE best_at BETWEEN start AND "end" """))
def endpoint_interval(spark, sf):
    rows = relation(spark, sf, "emission").withColumn("v", F.round(F.col("logl") * 40).cast("long"))
    return W.endpoint_interval(rows, ["tree_id"], "site", "v", 30)


@query("reference_numbering", oracle("""WITH n AS (SELECT site, CASE WHEN COUNT(*) FILTER (base > 1) >= 3 THEN site END AS num FROM aln GROUP BY site), c AS (SELECT site, num, last_value(num IGNORE NULLS) OVER w AS carried, COUNT(num) OVER w AS isle FROM n WINDOW w AS (ORDER BY site ROWS UNBOUNDED PRECEDING))
    SELECT site, num, carried, (SUM((num IS NULL)::INT) OVER (PARTITION BY isle ORDER BY site ROWS UNBOUNDED PRECEDING))::BIGINT AS insertion FROM c"""))
def reference_numbering(spark, sf):
    n = relation(spark, sf, "aln").groupBy("site").agg(F.count_if(F.col("base") > 1).alias("k")).select("site", F.when(F.col("k") >= 3, F.col("site")).alias("num"), F.lit(1).alias("g"))
    return W.renumber(n, ["g"], "site", "num").drop("g")


@query("emission_smoothed", oracle("SELECT tree_id, site, round((COALESCE(lag(logl) OVER w, logl) + 2 * logl + COALESCE(lead(logl) OVER w, logl)) / 4, 6) AS smoothed FROM emission WINDOW w AS (PARTITION BY tree_id ORDER BY site)"))
def smoothed(spark, sf):
    return rounded(W.smooth(relation(spark, sf, "emission"), ["tree_id"], "site", "logl").select("tree_id", "site", "smoothed"))


@query("emission_integral", oracle("SELECT tree_id, site, round(SUM(p) OVER (PARTITION BY tree_id ORDER BY site ROWS UNBOUNDED PRECEDING), 6) AS integral FROM (SELECT tree_id, site, COALESCE((lag(logl) OVER (PARTITION BY tree_id ORDER BY site) + logl) / 2, 0.0) AS p FROM emission)"))
def integral(spark, sf):
    return rounded(W.cumulative_integral(relation(spark, sf, "emission"), ["tree_id"], "site", "logl", 1.0).select("tree_id", "site", "integral"))


@query("top_k_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, sf):
    return R.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("top_k_each_chain", oracle("SELECT dataset, key, value, rank FROM (SELECT dataset, key, round(value, 6) AS value, (row_number() OVER (PARTITION BY dataset ORDER BY value DESC, key))::INT AS rank FROM signal WHERE metric = 'omega') WHERE rank <= 3"))
def top_k_each(spark, sf):
    return rounded(R.top_k_each(relation(spark, sf, "signal").filter("metric = 'omega'").select("dataset", "key", "value"), ["dataset"], 3, F.desc("value"), F.col("key")))


@query("top_mass_categories", oracle("""WITH n AS (SELECT site, category, round(-logl * 100)::BIGINT AS mass FROM lik), t AS (SELECT site, SUM(mass) AS t FROM n GROUP BY site),
    r AS (SELECT site, category, mass, t, row_number() OVER w AS rank, SUM(mass) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM n JOIN t USING (site) WINDOW w AS (PARTITION BY site ORDER BY mass DESC, category)),
    k AS (SELECT * FROM r WHERE cum - mass < 400 AND rank <= 12) SELECT site, category, mass, rank::INT AS rank, round(mass::DOUBLE / SUM(mass) OVER (PARTITION BY site), 6) AS share FROM k"""))
def top_mass(spark, sf):
    rows = relation(spark, sf, "lik").select("site", "category", F.round(-F.col("logl") * 100).cast("long").alias("mass"))
    return rounded(R.top_mass(rows, ["site"], "category", "mass", 400, 12))


@query("diverse_candidates", oracle("""WITH r AS (SELECT dataset, key, row_number() OVER (PARTITION BY dataset ORDER BY value DESC, key) AS rank, COUNT(*) OVER (PARTITION BY dataset) AS n FROM signal WHERE metric = 'omega')
    SELECT dataset, key, rank::INT AS rank FROM r WHERE rank <= 7 OR rank IN (floor(0.5 * n / 3)::INT + 1, floor(1.5 * n / 3)::INT + 1, floor(2.5 * n / 3)::INT + 1)"""))
def diverse(spark, sf):
    rows = relation(spark, sf, "signal").filter("metric = 'omega'")
    return R.diverse(rows, ["dataset"], 10, F.desc("value"), F.col("key")).select("dataset", "key", "rank")


@query("evenly_spaced", "SELECT i::INT AS i, floor((i + 0.5) * 97 / 10)::INT AS \"index\" FROM (SELECT unnest(range(10)) AS i)")
def evenly(spark, sf):
    return R.evenly_spaced(spark, 97, 10)


@query("best_candidate_per_key", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r FROM customer) WHERE r = 1")
def best_candidate(spark, sf):
    return R.best_of(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], F.col("c_acctbal"), "c_custkey")


_SPLITS = """a AS (SELECT tree_id, list(DISTINCT tip) AS every FROM clades GROUP BY tree_id), c AS (SELECT tree_id, clade, list_sort(list(DISTINCT tip)) AS side FROM clades GROUP BY tree_id, clade),
    d AS (SELECT tree_id, side, list_sort(list_filter(every, lambda x: NOT list_contains(side, x))) AS other FROM c JOIN a USING (tree_id)),
    s AS (SELECT DISTINCT tree_id, CASE WHEN len(side) < len(other) THEN array_to_string(side, ',') WHEN len(side) > len(other) THEN array_to_string(other, ',') ELSE least(array_to_string(side, ','), array_to_string(other, ',')) END AS split,
      least(len(side), len(other))::INT AS size FROM d WHERE len(side) >= 2 AND len(other) >= 2)"""


@query("tree_splits", oracle(f"WITH {_SPLITS} SELECT * FROM s"))
def splits(spark, sf):
    return R.splits(relation(spark, sf, "clades"))


@query("tree_signature", oracle(f"WITH {_SPLITS} SELECT tree_id, string_agg(split, ';' ORDER BY split) AS signature FROM s GROUP BY tree_id"))
def signature(spark, sf):
    return R.signature(R.splits(relation(spark, sf, "clades")))


@query("tree_split_distance", oracle(f"""WITH {_SPLITS}, m AS (SELECT split, SUM(CASE tree_id WHEN 'A' THEN 1 ELSE 2 END) AS x FROM s GROUP BY split), n AS (SELECT COUNT(*) FILTER (x = 1) AS only_a, COUNT(*) FILTER (x = 2) AS only_b, COUNT(*) FILTER (x = 3) AS shared FROM m)
    SELECT only_a, only_b, only_a + only_b AS distance, (only_a + only_b) / 2.0::DOUBLE AS half, round((only_a + only_b)::DOUBLE / (only_a + only_b + 2 * shared), 6) AS normalised FROM n"""))
def split_distance(spark, sf):
    return rounded(R.split_distance(R.splits(relation(spark, sf, "clades")), "A", "B"))


@query("tree_resolved", oracle(f"WITH {_SPLITS} SELECT tree_id, COUNT(DISTINCT split) AS splits, COUNT(DISTINCT split) = 22 AS resolved FROM s GROUP BY tree_id"))
def resolved(spark, sf):
    return R.resolved(R.splits(relation(spark, sf, "clades")), 25)


@query("tree_rooted_clades", oracle("SELECT tree_id, clade, string_agg(DISTINCT tip, ',' ORDER BY tip) AS tips, COUNT(DISTINCT tip) AS size FROM clades GROUP BY 1, 2 HAVING COUNT(DISTINCT tip) > 1"))
def rooted_clades(spark, sf):
    return R.rooted_clades(relation(spark, sf, "clades"))


_WALK = """WITH RECURSIVE w AS (SELECT node_id, [node_id] AS path, 0.0::DOUBLE AS distance FROM tree WHERE parent_id IS NULL UNION ALL
    SELECT t.node_id, list_append(w.path, t.node_id), w.distance + t.length FROM tree t JOIN w ON t.parent_id = w.node_id)"""


@query("tree_root_paths", oracle(f"{_WALK} SELECT node_id, array_to_string(path, '/') AS path, round(distance, 6) AS distance FROM w"))
def root_paths(spark, sf):
    paths = T.ancestors(relation(spark, sf, "tree"))
    return rounded(paths.select("node_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "distance"))


@query("tree_tip_counts", oracle(f"{_WALK} SELECT p AS node_id, COUNT(*) AS tips FROM (SELECT unnest(path) AS p FROM w WHERE len(path) = 3) GROUP BY p"))
def tip_counts(spark, sf):
    return T.tip_counts(relation(spark, sf, "tree"))


@query("tree_leaf_sets", oracle(f"{_WALK}, x AS (SELECT unnest(path) AS node_id, node_id AS tip FROM w WHERE len(path) = 3) SELECT x.node_id, string_agg(t.name, ',' ORDER BY t.name) AS tips FROM x JOIN tree t ON t.node_id = x.tip WHERE x.node_id <> x.tip GROUP BY x.node_id"))
def leaf_sets(spark, sf):
    return T.leaf_sets(relation(spark, sf, "tree"))


@query("tree_traversal_order", oracle(f"""{_WALK}, k AS (SELECT node_id, path, row_number() OVER (ORDER BY list_transform(path, lambda x: lpad(x::VARCHAR, 10, '0'))) AS pre FROM w),
    n AS (SELECT p AS node_id, COUNT(*) AS n FROM (SELECT unnest(path) AS p FROM w) GROUP BY p) SELECT node_id, pre::INT AS pre, (pre - len(path) + n)::INT AS post FROM k JOIN n USING (node_id)"""))
def traversal(spark, sf):
    return T.order(relation(spark, sf, "tree"))


@query("tree_patristic", oracle(f"""{_WALK}, t AS (SELECT node_id, path, distance FROM w WHERE len(path) = 3) SELECT a.node_id AS a, b.node_id AS b, round(a.distance + b.distance - 2 * CASE WHEN a.path[2] = b.path[2] THEN (SELECT distance FROM w WHERE w.node_id = a.path[2]) ELSE 0.0 END, 6) AS distance
    FROM t a JOIN t b ON a.node_id < b.node_id"""))
def patristic(spark, sf):
    tree = relation(spark, sf, "tree")
    return rounded(T.patristic(tree, tree.filter("depth = 2")))


@query("tree_pruned", oracle("""WITH k AS (SELECT node_id, parent_id, length FROM tree WHERE depth = 2 AND node_id % 5 IN (1, 2)), r AS (SELECT parent_id, COUNT(*) AS n FROM k GROUP BY parent_id), top AS (SELECT COUNT(*) AS n FROM r)
    SELECT 0 AS node_id, NULL::INT AS parent_id, 0.0::DOUBLE AS length UNION ALL SELECT t.node_id, 0, round(t.length, 6) FROM tree t JOIN r ON r.parent_id = t.node_id WHERE n > 1
    UNION ALL SELECT k.node_id, CASE WHEN n > 1 THEN k.parent_id ELSE 0 END, round(CASE WHEN n > 1 THEN k.length ELSE k.length + t.length END, 6) FROM k JOIN r USING (parent_id) JOIN tree t ON t.node_id = k.parent_id"""))
def pruned(spark, sf):
    tree = relation(spark, sf, "tree")
    return rounded(T.prune_to(tree, tree.filter("depth = 2 AND node_id % 5 IN (1, 2)")))


@query("tree_newick", oracle("""WITH t AS (SELECT parent_id, string_agg('''' || name || ''':' || length, ',' ORDER BY name) AS x FROM tree WHERE depth = 2 GROUP BY parent_id),
    r AS (SELECT string_agg('(' || x || ')''' || name || ''':' || length, ',' ORDER BY name) AS x FROM tree JOIN t ON t.parent_id = node_id WHERE depth = 1) SELECT '(' || x || ')''root'';' AS newick FROM r"""))
def newick(spark, sf):
    return T.newick(relation(spark, sf, "tree"))


@query("tree_fitch_cost", oracle("""WITH m AS (SELECT n_regionkey AS r, site, n_nationkey AS tip, COALESCE(base, 0) AS b FROM nation JOIN aln ON taxon = n_nationkey % 8 WHERE base IS NOT NULL),
    c AS (SELECT r, site, b, COUNT(*) AS n FROM m GROUP BY ALL), k AS (SELECT r, site, COUNT(*) AS kids FROM m GROUP BY ALL), t AS (SELECT r, site, MAX(n) AS top FROM c GROUP BY ALL),
    up AS (SELECT c.r, c.site, c.b FROM c JOIN t USING (r, site) WHERE n = top), u AS (SELECT site, b, COUNT(*) AS n FROM up GROUP BY ALL), ut AS (SELECT site, MAX(n) AS top FROM u GROUP BY site), uk AS (SELECT site, COUNT(DISTINCT r) AS kids FROM m GROUP BY site),
    low AS (SELECT site, SUM(kids - top) AS cost FROM k JOIN t USING (r, site) GROUP BY site) SELECT site, (low.cost + uk.kids - ut.top)::BIGINT AS cost FROM low JOIN ut USING (site) JOIN uk USING (site)"""))
def fitch(spark, sf):
    return T.fitch(relation(spark, sf, "tree"), _tip_masks(spark, sf))


def _tip_masks(spark, sf):
    tips = relation(spark, sf, "tree").filter("depth = 2").select("node_id", ((F.col("node_id") - 100) % 8).alias("taxon"))
    return tips.join(relation(spark, sf, "aln").filter("base IS NOT NULL"), "taxon").select("node_id", "site", F.call_function("shiftleft", F.lit(1), F.col("base")).alias("mask"))


@query("tree_sankoff_cost", oracle("""WITH m AS (SELECT n_regionkey AS r, site, base AS b FROM nation JOIN aln ON taxon = n_nationkey % 8 WHERE base IS NOT NULL), q AS (SELECT unnest(range(4))::INT AS a),
    c AS (SELECT r, site, a, SUM(CASE WHEN a = b THEN 0 WHEN (a + b) % 2 = 0 THEN 1 ELSE 2 END) AS c FROM m, q GROUP BY ALL),
    u AS (SELECT r, site, q.a AS a, MIN(c.c + CASE WHEN q.a = c.a THEN 0 WHEN (q.a + c.a) % 2 = 0 THEN 1 ELSE 2 END) AS c FROM c, q GROUP BY ALL), s AS (SELECT site, a, SUM(c) AS c FROM u GROUP BY ALL)
    SELECT site, MIN(c)::DOUBLE AS cost FROM s GROUP BY site"""))
def sankoff(spark, sf):
    return T.sankoff(relation(spark, sf, "tree"), _tip_masks(spark, sf), 1.0, 2.0)


_NETWORKS = """n AS (SELECT o_custkey AS hash, o_orderkey AS id, round(o_totalprice)::BIGINT AS objective, o_orderkey % 1009 AS data, o_custkey % 4 AS bridges, least(o_orderkey % 5, o_custkey % 4) AS used, o_orderkey % 13 AS priority FROM orders),
    c AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY hash ORDER BY objective, id) = 1)"""


@query("candidate_beam", oracle(f"""WITH {_NETWORKS}, t AS (
      SELECT *, row_number() OVER (ORDER BY objective, data, hash) AS turn, 0 AS o FROM c WHERE used = bridges
      UNION ALL SELECT *, row_number() OVER (ORDER BY objective, data, hash), 1 FROM c
      UNION ALL SELECT *, row_number() OVER (ORDER BY data, objective, hash), 2 FROM c
      UNION ALL SELECT *, row_number() OVER (ORDER BY used DESC, objective, hash), 3 FROM c
      UNION ALL SELECT *, row_number() OVER (ORDER BY priority DESC, objective - 8 * bridges, hash), 4 FROM c WHERE used <> bridges)
    SELECT hash, id, objective, data, bridges, used, priority FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY hash ORDER BY turn, o) = 1) ORDER BY turn, o LIMIT 24"""))
def candidate_beam(spark, sf):
    """24 candidates in turn from five rankings: whole use, objective, fit, coverage and bridges not used yet; one of each hash."""
    o = table(spark, sf, "orders")
    bridges = F.col("o_custkey") % 4
    rows = o.select(
        F.col("o_custkey").alias("hash"), F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("long").alias("objective"), (F.col("o_orderkey") % 1009).alias("data"),
        bridges.alias("bridges"), F.least(F.col("o_orderkey") % 5, bridges).alias("used"), (F.col("o_orderkey") % 13).alias("priority"),
    )
    rows = R.best_of(rows, ["hash"], F.col("objective"), "id")
    every, whole = F.lit(True), F.col("used") == F.col("bridges")
    orders = [
        (whole, [F.col("objective"), F.col("data"), F.col("hash")]), (every, [F.col("objective"), F.col("data"), F.col("hash")]), (every, [F.col("data"), F.col("objective"), F.col("hash")]),
        (every, [F.desc("used"), F.col("objective"), F.col("hash")]), (~whole, [F.desc("priority"), F.col("objective") - 8 * F.col("bridges"), F.col("hash")]),
    ]
    return R.round_robin(rows, ["hash"], 24, orders)


_EDGES = "e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation) WHERE a <> b), f AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def _edges(spark, sf):
    n = table(spark, sf, "nation")
    one = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("b"))
    two = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 5) % 25).alias("b"))
    return one.unionByName(two).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


_BFS = f"{_EDGES}, s(source, node, level) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT s.source, f.b, s.level + 1 FROM s JOIN f ON f.a = s.node WHERE s.level < 8)"


@query("graph_bfs", oracle(f"WITH RECURSIVE {_BFS} SELECT source, node, MIN(level) AS level FROM s GROUP BY source, node"))
def bfs(spark, sf):
    start = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return T.bfs(_edges(spark, sf), start, 8)


@query("graph_medoid", oracle(f"""WITH RECURSIVE {_BFS}, d AS (SELECT source, node, MIN(level) AS level FROM s GROUP BY source, node)
    SELECT source AS node, round(SUM(sqrt(n) * level), 6) AS total FROM d JOIN (SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY 1) ON c_nationkey = node GROUP BY source ORDER BY SUM(sqrt(n) * level), source LIMIT 1"""))
def medoid(spark, sf):
    occupancy = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("state")).agg(F.count(F.lit(1)).alias("occupancy"))
    return rounded(T.medoid(bfs(spark, sf), occupancy))


@query("graph_shortest_path", oracle(f"""WITH RECURSIVE {_EDGES}, p(node, path, n) AS (SELECT 0, [0], 0 UNION ALL SELECT f.b, list_append(p.path, f.b), p.n + 1 FROM p JOIN f ON f.a = p.node WHERE p.n < 6 AND NOT list_contains(p.path, f.b)),
    g AS (SELECT path, n FROM p WHERE node = 23), m AS (SELECT MIN(n) AS n FROM g) SELECT array_to_string(MIN(path), '-') AS path, COUNT(*) AS alternatives FROM g JOIN m USING (n)"""))
def shortest(spark, sf):
    found = T.shortest_path(_edges(spark, sf), 0, 23, 6)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"), "alternatives")


@query("tip_order_crossings", "WITH r AS (SELECT n_nationkey AS r1, (n_nationkey * 7) % 25 AS r2 FROM nation) SELECT COUNT(*) AS crossings FROM r a JOIN r b ON a.r1 < b.r1 AND a.r2 > b.r2")
def crossings(spark, sf):
    return T.crossings(table(spark, sf, "nation").select(F.col("n_nationkey").alias("r1"), ((F.col("n_nationkey") * 7) % 25).alias("r2")))


@query("regions_of_codons", oracle("""WITH c AS (SELECT c AS codon, tree_id FROM (SELECT unnest(range(1, (SELECT MAX("end") // 3 + 1 FROM region_runs)))::INT AS c) JOIN region_runs ON 3 * c - 1 BETWEEN start AND "end"),
    m AS (SELECT codon, tree_id, SUM(x) OVER (ORDER BY codon) AS g FROM (SELECT *, CASE WHEN lag(tree_id) OVER (ORDER BY codon) = tree_id THEN 0 ELSE 1 END AS x FROM c)) SELECT MIN(codon) AS start_codon, MAX(codon) AS end_codon, tree_id FROM m GROUP BY g, tree_id"""))
def regions_of_codons(spark, sf):
    regions = relation(spark, sf, "region_runs")
    return I.codons_to_regions(regions.agg(F.max("end")).first()[0] // 3, regions)


@query("region_cover_check", oracle("""WITH r AS (SELECT start + (tree_id = 'T2')::INT AS start, "end" + 2 * (tree_id = 'T3')::INT AS "end" FROM region_runs), s AS (SELECT start, "end", COALESCE(start - lag("end") OVER (ORDER BY start) - 1, 0) AS s FROM r) SELECT start, "end", greatest(s, 0) AS gap, greatest(-s, 0) AS overlap FROM s"""))
def cover_check(spark, sf):
    r = relation(spark, sf, "region_runs").select((F.col("start") + (F.col("tree_id") == "T2").cast("int")).alias("start"), (F.col("end") + 2 * (F.col("tree_id") == "T3").cast("int")).alias("end"))
    return I.cover_check(r)


@query("sites_to_local_trees", oracle("SELECT DISTINCT taxon, site, tree_id FROM aln JOIN region_runs ON site BETWEEN start AND \"end\""))
def sites_to_trees(spark, sf):
    return I.locate(relation(spark, sf, "aln").select("taxon", "site"), "site", relation(spark, sf, "region_runs")).select("taxon", "site", "tree_id")


@query("region_overlaps", oracle("""WITH b AS (SELECT start + 5 AS start, "end" + 9 AS "end", tree_id FROM region_runs) SELECT a.tree_id AS a_id, b.tree_id AS b_id, a.start AS "as", b.start AS bs, least(a."end", b."end") - greatest(a.start, b.start) + 1 AS shared
    FROM region_runs a JOIN b ON a.start <= b."end" AND b.start <= a."end" """))
def region_overlaps(spark, sf):
    a = relation(spark, sf, "region_runs")
    return I.overlaps(a, a.select((F.col("start") + 5).alias("start"), (F.col("end") + 9).alias("end"), "tree_id"))


@query("region_family_windows", oracle("""WITH w AS (SELECT start, "end", lead("end", 1) OVER (ORDER BY start) AS e2, lead("end", 2) OVER (ORDER BY start) AS e3 FROM region_runs)
    SELECT MIN(start) AS start, MAX("end") AS "end", 'global' AS label, 0 AS rank FROM region_runs UNION ALL SELECT start, "end", 'segment', 1 FROM w UNION ALL SELECT start, e2, 'pair', 2 FROM w WHERE e2 IS NOT NULL UNION ALL SELECT start, e3, 'triplet', 3 FROM w WHERE e3 IS NOT NULL"""))
def family_windows(spark, sf):
    return I.family_windows(relation(spark, sf, "region_runs"))


@query("region_window_union", oracle("""WITH w AS (SELECT start, "end", lead("end", 1) OVER (ORDER BY start) AS e2, lead("end", 2) OVER (ORDER BY start) AS e3 FROM region_runs), u AS (
      SELECT MIN(start) AS start, MAX("end") AS "end", 'global' AS label, 0 AS rank FROM region_runs UNION ALL SELECT start, "end", 'segment', 1 FROM w UNION ALL SELECT start, e2, 'pair', 2 FROM w WHERE e2 IS NOT NULL UNION ALL SELECT start, e3, 'triplet', 3 FROM w WHERE e3 IS NOT NULL
      UNION ALL SELECT s::INT, (s + w - 1)::INT, 'overlap', 4 FROM (SELECT unnest(range(1, n - w + 2, w // 2)) AS s, w FROM (SELECT MAX("end") AS n, MAX("end") // 4 AS w FROM region_runs)))
    SELECT start, "end", label, rank FROM (SELECT *, row_number() OVER (PARTITION BY start, "end" ORDER BY rank, label) AS k FROM u) WHERE k = 1"""))
def window_union(spark, sf):
    regions = relation(spark, sf, "region_runs")
    both = I.family_windows(regions).unionByName(I.overlap_windows(spark, regions.agg(F.max("end")).first()[0]))
    return R.union_first(both, "rank")


@query("breaks_per_site", oracle("""SELECT s AS site, COALESCE(n, 0) AS breaks FROM (SELECT unnest(range(1, (SELECT MAX(l_orderkey) // 5 + 2 FROM lineitem)))::INT AS s) LEFT JOIN (SELECT (o_orderkey // 5 + 1)::INT AS b, COUNT(*) AS n FROM orders GROUP BY 1) ON b = s"""))
def breaks(spark, sf):
    b = table(spark, sf, "orders").select(F.expr("int(o_orderkey div 5 + 1)").alias("breakpoint"))
    return I.break_counts(b, table(spark, sf, "lineitem").agg(F.max("l_orderkey")).first()[0] // 5 + 1)


@query("region_changed_splits", oracle(f"""WITH {_SPLITS}, r AS (SELECT "end", CASE WHEN tree_id IN ('T0', 'T3') THEN 'A' ELSE 'B' END AS t, start FROM region_runs), p AS (SELECT "end" AS boundary, t AS before, lead(t) OVER (ORDER BY start) AS after FROM r), q AS (SELECT * FROM p WHERE after IS NOT NULL AND before <> after),
    ch AS (SELECT boundary, 'lost' AS kind, split, size FROM q JOIN s ON s.tree_id = before WHERE split NOT IN (SELECT split FROM s x WHERE x.tree_id = after) UNION ALL SELECT boundary, 'gained', split, size FROM q JOIN s ON s.tree_id = after WHERE split NOT IN (SELECT split FROM s x WHERE x.tree_id = before))
    SELECT boundary, kind, split, size, rank FROM (SELECT *, (row_number() OVER (PARTITION BY boundary, kind ORDER BY size, split))::INT AS rank FROM ch) WHERE rank <= 2"""))
def changed_splits(spark, sf):
    r = relation(spark, sf, "region_runs").withColumn("tree_id", F.when(F.col("tree_id").isin("T0", "T3"), "A").otherwise("B"))
    return I.changed_splits(r, R.splits(relation(spark, sf, "clades")), 2)


@query("segment_scatter", oracle("SELECT site + 200 * b AS site, category, round(logl, 6) AS logl FROM (SELECT site, category, logl, (category % 2)::INT AS b FROM lik)"))
def scatter(spark, sf):
    blocks = relation(spark, sf, "lik").withColumn("region", F.col("category") % 2)
    offsets = spark.range(2).select(F.col("id").cast("int").alias("region"), (F.col("id") * 200).cast("int").alias("offset"))
    return rounded(I.scatter(blocks, offsets))


@query("branch_path_lengths", oracle("SELECT n_regionkey AS branch, round(SUM((1 + n_nationkey % 7) / 10.0::DOUBLE), 6) AS length FROM nation GROUP BY n_regionkey"))
def path_lengths(spark, sf):
    n = table(spark, sf, "nation")
    edges = n.groupBy(F.col("n_regionkey").alias("branch")).agg(F.collect_list("n_nationkey").alias("atoms"))
    return rounded(T.path_lengths(edges, n.select(F.col("n_nationkey").alias("atom"), ((1 + F.col("n_nationkey") % 7) / 10.0).alias("length"))))


@query("duplicate_branch_columns", "SELECT least((10 + n_nationkey % 2)::VARCHAR, n_regionkey::VARCHAR) || ',' || greatest((10 + n_nationkey % 2)::VARCHAR, n_regionkey::VARCHAR) AS signature, array_to_string(list_sort(list(n_nationkey)), ',') AS atoms FROM nation GROUP BY n_regionkey, n_nationkey % 2 HAVING COUNT(*) > 1")
def duplicate_columns(spark, sf):
    n = table(spark, sf, "nation")
    one = n.groupBy(F.col("n_regionkey").alias("branch")).agg(F.collect_list("n_nationkey").alias("atoms"))
    two = n.groupBy((10 + F.col("n_nationkey") % 2).alias("branch")).agg(F.collect_list("n_nationkey").alias("atoms"))
    found = T.duplicate_columns(one.unionByName(two))
    return found.select("signature", F.array_join(F.transform("atoms", lambda x: x.cast("string")), ",").alias("atoms"))
