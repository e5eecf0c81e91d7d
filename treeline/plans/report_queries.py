"""Queries of reports, bundles, evaluation over regions and orchestration."""

from __future__ import annotations

from ..functions import codes
from ..functions import scalars as S
from ..operators import alignment as A
from ..operators import ranking as R
from ..operators import reports as P
from ..operators import trees as T
from .helpers import F, oracle, query, relation, rounded, table


@query("report_flattened", "SELECT o_orderkey AS \"order.key\", o_orderstatus AS \"order.state.code\", round(o_totalprice, 2) AS \"order.state.price\" FROM orders")
def flattened(spark, sf):
    o = table(spark, sf, "orders")
    nested = o.select(F.struct(F.col("o_orderkey").alias("key"), F.array("o_orderkey").alias("list"), F.struct(F.col("o_orderstatus").alias("code"), F.round("o_totalprice", 2).alias("price")).alias("state")).alias("order"))
    return P.flatten_scalars(nested)


@query("report_call_columns", oracle("SELECT dataset, method, COUNT(*) FILTER (CASE method WHEN 'ratio_test' THEN value <= 0.05 ELSE value > 0.9 END) AS called FROM signal GROUP BY dataset, method"))
def call_columns(spark, sf):
    return P.call_columns(relation(spark, sf, "signal")).groupBy("dataset", "method").agg(F.count_if("called").alias("called"))


@query("bundle_round_trip", oracle("SELECT start, \"end\", tree_id, '(' || tree_id || ');' AS newick FROM region_runs"))
def bundle(spark, sf):
    regions = relation(spark, sf, "region_runs")
    trees = regions.select("tree_id").distinct().withColumn("newick", F.concat(F.lit("("), "tree_id", F.lit(");")))
    sites = regions.agg(F.max("end")).first()[0]
    return P.read_bundle(P.bundle(regions, trees, sites), sites)[0]


@query("bundle_problems", oracle("""WITH r AS (SELECT start + 2 * (tree_id = 'T1')::INT AS start, "end" FROM region_runs), s AS (SELECT start, start - COALESCE(lag("end") OVER (ORDER BY start), 0) - 1 AS step FROM r) SELECT start, CASE WHEN step > 0 THEN 'gap' ELSE 'overlap' END AS problem FROM s WHERE step <> 0"""))
def bundle_problems(spark, sf):
    regions = relation(spark, sf, "region_runs").select((F.col("start") + 2 * (F.col("tree_id") == "T1").cast("int")).alias("start"), "end", "tree_id")
    trees = regions.select("tree_id").distinct().withColumn("newick", F.lit("(a,b);"))
    sites = regions.agg(F.max("end")).first()[0]
    return P.read_bundle(P.bundle(regions, trees, sites), sites)[1]


@query("truth_inference_join", oracle("SELECT s.dataset, t.site, label, round(s.value, 6) AS value FROM truth t JOIN (SELECT dataset, key AS site, value FROM signal WHERE metric = 'omega') s ON s.site = t.site WHERE label IS NOT NULL"))
def truth_join(spark, sf):
    found = relation(spark, sf, "signal").filter("metric = 'omega'").select("dataset", F.col("key").cast("long").alias("site"), "value")
    # one truth for the inferences of every dataset
    truth = relation(spark, sf, "truth").select("site", "label").crossJoin(F.broadcast(found.select("dataset").distinct()))
    return rounded(P.site_truth_join(truth.select("dataset", "site", "label"), found))


@query("rows_with_signals", oracle("SELECT COALESCE(a.key, b.key) AS key, a.n, round(b.value, 6) AS value FROM (SELECT key, COUNT(*) AS n FROM signal WHERE metric = 'posterior' AND value > 0.5 GROUP BY key) a FULL JOIN (SELECT key, MAX(value) AS value FROM signal WHERE metric = 'omega' AND value > 1 GROUP BY key) b ON a.key = b.key"))
def with_signals(spark, sf):
    s = relation(spark, sf, "signal")
    a = s.filter("metric = 'posterior' AND value > 0.5").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    b = s.filter("metric = 'omega' AND value > 1").groupBy("key").agg(F.max("value").alias("value"))
    return rounded(P.rows_with_signals(a, b, "key"))


@query("compatible_routes", "SELECT m AS method, s AS source, k AS kind FROM (VALUES ('site', 'tree', false), ('site', 'true-tree', false), ('regional', 'tree', true), ('regional', 'true-tree', true), ('regional', 'segments', true)) a(m, k, r) JOIN (VALUES ('nj', 'tree'), ('truth', 'true-tree'), ('hmm', 'segments')) b(s, k) USING (k) WHERE NOT (k = 'true-tree' AND NOT r)")
def compatible(spark, sf):
    methods = spark.createDataFrame([("site", ["tree", "true-tree"], False), ("regional", ["tree", "true-tree", "segments"], True)], "method string, accepts array<string>, regional boolean")
    sources = spark.createDataFrame([("nj", "tree"), ("truth", "true-tree"), ("hmm", "segments")], "source string, kind string")
    return P.compatible(methods, sources, F.lit(True))


@query("taxa_equality", "SELECT (SELECT COUNT(*) FROM nation WHERE n_nationkey % 3 = 0) AS missing, 0::BIGINT AS extra, false AS equal")
def same_taxa(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return P.same_taxa(n, n.filter("n_nationkey % 3 <> 0"))


@query("overlap_integrated_distance", oracle("""WITH b AS (SELECT start + 5 AS start, "end" + 5 AS "end", tree_id FROM region_runs), m AS (SELECT least(a."end", b."end") - greatest(a.start, b.start) + 1 AS n, abs(substr(a.tree_id, 2)::INT - substr(b.tree_id, 2)::INT) AS rf
    FROM region_runs a JOIN b ON a.start <= b."end" AND b.start <= a."end") SELECT round(SUM(n * rf)::DOUBLE / SUM(n), 6) AS mean_rf, SUM(n)::BIGINT AS sites FROM m"""))
def overlap_distance(spark, sf):
    a = relation(spark, sf, "region_runs")
    ids = a.select("tree_id").distinct()
    d = ids.select(F.col("tree_id").alias("a_id")).crossJoin(ids.select(F.col("tree_id").alias("b_id"))).withColumn("rf", F.abs(F.substring("a_id", 2, 9).cast("int") - F.substring("b_id", 2, 9).cast("int")))
    return rounded(P.overlap_distance(a, a.select((F.col("start") + 5).alias("start"), (F.col("end") + 5).alias("end"), "tree_id"), d))


@query("site_averaged_distance", oracle("SELECT round(avg((site % 5) / 2.0 / 22), 6) AS mean_rf, round(avg((site % 5 = 0)::INT), 6) AS exact FROM (SELECT DISTINCT site FROM aln)"))
def site_distance(spark, sf):
    rows = relation(spark, sf, "aln").select("site").distinct().select("site", (F.col("site") % 5).alias("rf"))
    return rounded(P.site_distance(rows, 25))


@query("patristic_recovery", oracle("""WITH RECURSIVE w AS (SELECT node_id, [node_id] AS path, 0.0::DOUBLE AS d FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.node_id, list_append(w.path, t.node_id), w.d + t.length FROM tree t JOIN w ON t.parent_id = w.node_id),
    t AS (SELECT * FROM w WHERE len(path) = 3), p AS (SELECT a.node_id AS a, b.node_id AS b, a.d + b.d - 2 * CASE WHEN a.path[2] = b.path[2] THEN (SELECT d FROM w WHERE w.node_id = a.path[2]) ELSE 0.0 END AS x FROM t a JOIN t b ON a.node_id < b.node_id),
    q AS (SELECT x, x + ((a * 7 + b) % 5) / 100.0::DOUBLE AS y FROM p) SELECT COUNT(*) AS pairs, round(avg(abs(y - x)), 6) AS mae, round(sqrt(avg((y - x) * (y - x))), 6) AS rmse, round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) AS correlation, round(covar_pop(x, y) / var_pop(x), 6) AS slope FROM q"""))
def patristic_recovery(spark, sf):
    tree = relation(spark, sf, "tree")
    truth = T.patristic(tree, tree.filter("depth = 2"))
    return rounded(P.recovery(truth, truth.withColumn("distance", F.col("distance") + ((F.col("a") * 7 + F.col("b")) % 5) / 100.0)))


@query("mass_array_expectation", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: greatest(embedding[i], 0)::DOUBLE * i)) / list_sum(list_transform(embedding, lambda x: greatest(x, 0)::DOUBLE)), 5) AS mean FROM embeddings")
def mass_expectation(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("mass", F.transform("embedding", lambda x: F.greatest(x, F.lit(0)).cast("double")))
    return e.select("vec_id", F.round(P.mass_expectation(e, "mass", [float(i) for i in range(1, 65)]), 5).alias("mean"))


@query("profile_logo", oracle(f"""WITH c(codon, aa) AS (VALUES {", ".join(f"('{c}', '{a}')" for c, a in sorted(codes.genetic_code(1).items()))}), k AS (SELECT codon_site, nullif(aa, '*') AS aa, COUNT(*) AS n FROM codons LEFT JOIN c USING (codon) GROUP BY 1, 2),
    w AS (SELECT *, SUM(n) OVER (PARTITION BY codon_site) AS every FROM k), h AS (SELECT codon_site, aa, n::DOUBLE / every AS height FROM w WHERE aa IS NOT NULL)
    SELECT codon_site, aa, round(height, 6) AS height, round(COALESCE(SUM(height) OVER (PARTITION BY codon_site ORDER BY height, aa DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS bottom FROM h"""))
def logo(spark, sf):
    return rounded(P.logo(A.amino_acid_profile(relation(spark, sf, "codons")).withColumn("frequency", F.col("frequency"))))


@query("site_hypotheses", oracle("SELECT site, h AS hypothesis, v AS value FROM (SELECT site, unnest(['score', 'p']) AS h, unnest([score, p]) AS v FROM truth) WHERE v > 0.8"))
def hypotheses(spark, sf):
    return P.hypotheses(relation(spark, sf, "truth"), ["score", "p"], 0.8)


@query("hotspot_weights", "SELECT s::INT AS site, round(1 + SUM(i * exp(-0.5 * ((s - c) / w::DOUBLE) * ((s - c) / w::DOUBLE))), 6) AS weight FROM (SELECT unnest(range(1, (SELECT MAX(l_orderkey) // 5 + 1 FROM lineitem))) AS s), (SELECT 12 * n_nationkey AS c, 1 + n_regionkey AS i, 3 + n_nationkey % 4 AS w FROM nation) GROUP BY s")
def hotspots(spark, sf):
    n = table(spark, sf, "nation").select((12 * F.col("n_nationkey")).alias("centre"), (1 + F.col("n_regionkey")).alias("intensity"), (3 + F.col("n_nationkey") % 4).alias("width"))
    return rounded(P.hotspots(table(spark, sf, "lineitem").agg(F.max("l_orderkey")).first()[0] // 5 + 1, n))


@query("event_pool", "SELECT l_shipmode AS move, SUM(n)::BIGINT AS support, COUNT(*) AS seen FROM (SELECT l_returnflag || l_linestatus || (l_partkey % 50) AS l_shipmode, l_linenumber AS n FROM lineitem) GROUP BY 1 ORDER BY SUM(n) DESC, 1 LIMIT 20")
def event_pool(spark, sf):
    moves = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 50).cast("string")).alias("move"), F.col("l_linenumber").alias("support"))
    return P.event_pool(moves, 20)


@query("bit_transition_rates", oracle("""WITH s AS (SELECT state AS m, lead(state) OVER (PARTITION BY chain ORDER BY pos) AS n FROM events_chain), e AS (SELECT b AS bit, (m >> b) & 1 AS x, (n >> b) & 1 AS y FROM s, (SELECT unnest(range(2))::INT AS b) WHERE n IS NOT NULL),
    k AS (SELECT bit, COUNT(*) FILTER (x = 0 AND y = 1) AS o, COUNT(*) FILTER (x = 0 AND y = 0) AS oo, COUNT(*) FILTER (x = 1 AND y = 0) AS c, COUNT(*) FILTER (x = 1 AND y = 1) AS cc FROM e GROUP BY bit) SELECT bit, round((o + 0.5) / (o + oo + 1), 6)::DOUBLE AS opened, round((c + 0.5) / (c + cc + 1), 6)::DOUBLE AS closed FROM k"""))
def bit_transitions(spark, sf):
    return rounded(P.bit_transitions(relation(spark, sf, "events_chain").withColumnRenamed("state", "mask"), 2))


_CODE = ", ".join(f"('{c}', '{a}')" for c, a in sorted(codes.genetic_code(1).items()))


@query("rate_model_bank", oracle(f"""WITH f AS (SELECT ((site - 1) % 3 + 1)::INT AS position, letter, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY (site - 1) % 3) AS frequency FROM cells GROUP BY 1, 2, (site - 1) % 3),
    c(codon, aa) AS (VALUES {_CODE}), p AS (SELECT codon, aa, x.frequency * y.frequency * z.frequency AS v FROM c JOIN f x ON x.position = 1 AND x.letter = substr(codon, 1, 1)
      JOIN f y ON y.position = 2 AND y.letter = substr(codon, 2, 1) JOIN f z ON z.position = 3 AND z.letter = substr(codon, 3, 1) WHERE aa <> '*'), e AS (SELECT codon, aa, v / SUM(v) OVER () AS pi FROM p)
    SELECT round(alpha, 6) AS alpha, round(beta, 6) AS beta, a.codon AS from_codon, b.codon AS to_codon, round(CASE WHEN a.aa = b.aa THEN alpha ELSE beta END * b.pi, 6) AS rate
    FROM (SELECT DISTINCT alpha, beta FROM grid) CROSS JOIN e a JOIN e b ON hamming(a.codon, b.codon) = 1"""))
def rate_bank(spark, sf):
    table_one = codes.code_table(spark, (1,))
    pi = A.codon_equilibrium(A.f3x4(relation(spark, sf, "codons")), table_one)
    return rounded(P.rate_bank(codes.codon_neighbors(table_one), relation(spark, sf, "grid"), pi))


@query("store_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 7 <> 0")
def store_latest(spark, sf):
    store = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts", (F.col("event_id") % 7 == 0).alias("deleted"))
    return P.latest(store, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("spatially_reserved_top", None)
def spatial_top(spark, sf):
    return rounded(P.spatial_top(relation(spark, sf, "emission"), ["tree_id"], "site", "logl", 10, 15))


@query("newest_first", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_first(spark, sf):
    return R.top_k(table(spark, sf, "events").select("event_id", "ts"), 50, F.desc("ts"), F.desc("event_id"))


@query("parameter_counts", "SELECT s_suppkey, 2 * k - 1 + (k - 1) AS chain, k * 3 + (k - 1) AS segments FROM (SELECT s_suppkey, 1 + s_suppkey % 6 AS k FROM supplier)")
def parameter_counts(spark, sf):
    k = 1 + F.col("s_suppkey") % 6
    return table(spark, sf, "supplier").select("s_suppkey", (2 * k - 1 + (k - 1)).alias("chain"), (k * 3 + (k - 1)).alias("segments"))


@query("minimum_spans", "SELECT s_suppkey, least(greatest(60, 10 + s_suppkey % 80, CASE WHEN v > 0 THEN ceil(30 / v)::BIGINT ELSE 0 END), 150)::BIGINT AS span FROM (SELECT s_suppkey, (s_suppkey % 5)::DOUBLE / 10 AS v FROM supplier)")
def minimum_spans(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", S.minimum_span(10 + F.col("s_suppkey") % 80, F.lit(30.0), (F.col("s_suppkey") % 5) / 10.0, F.lit(300)).alias("span"))


@query("branch_scope", oracle("SELECT node_id, name, depth = 2 AS terminal FROM tree WHERE depth > 0 AND depth < 2 UNION ALL SELECT node_id, name, true FROM tree WHERE depth = 2 AND length > 0.5"))
def branch_scope(spark, sf):
    t = relation(spark, sf, "tree")
    inner = t.filter("depth > 0").join(t.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_semi").select("node_id", "name", F.lit(False).alias("terminal"))
    return inner.unionByName(t.join(t.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti").filter("length > 0.5").select("node_id", "name", F.lit(True).alias("terminal")))


@query("shared_tree_scale", oracle("SELECT node_id, round(length * 1.7::DOUBLE, 6) AS length FROM tree"))
def tree_scale(spark, sf):
    return rounded(relation(spark, sf, "tree").select("node_id", (F.col("length") * 1.7).alias("length")))


@query("replicate_seeds", "SELECT i::INT AS replicate, ((xor(11::BIGINT, (i * 2654435761) % 4294967296)) * 2246822519::HUGEINT % 4294967296)::BIGINT AS seed FROM (SELECT unnest(range(50)) AS i)")
def replicate_seeds(spark, sf):
    mixed = F.lit(11).cast("long").bitwiseXOR(F.pmod(F.col("id") * 2654435761, F.lit(1 << 32)))
    product = F.pmod(mixed.cast("decimal(20,0)") * F.lit(2246822519).cast("decimal(20,0)"), F.lit(1 << 32).cast("decimal(20,0)"))
    return spark.range(50).select(F.col("id").cast("int").alias("replicate"), product.cast("long").alias("seed"))


@query("pipeline_routes")
def pipeline_routes(spark, sf):
    from . import pipeline

    text = '{"schemaVersion": 1, "id": "q", "nodes": [{"id": "sim", "kind": "simulator", "parameters": {"replicates": 2, "taxa": 5, "codons": 20}}, {"id": "nj", "kind": "nj-tree"}, {"id": "true", "kind": "true-tree"}, {"id": "m", "kind": "selection", "modelId": "selection"}]}'
    return rounded(pipeline.run(spark, text)[0])
