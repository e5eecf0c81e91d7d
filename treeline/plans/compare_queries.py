"""Queries that compare signals, judge them against truth and write tables."""

from __future__ import annotations

from ..functions import scalars as S
from ..operators import compare as C
from .helpers import F, oracle, query, relation, rounded, table

_T = "CASE WHEN metric = 'p_value' THEN 0.05 WHEN metric = 'posterior' THEN 0.95 WHEN metric = 'omega' THEN 1.0 ELSE 0.0 END::DOUBLE"
_PASS = f"CASE WHEN metric = 'p_value' THEN value <= {_T} ELSE value >= {_T} END"


@query("signal_thresholds", oracle(f"SELECT DISTINCT metric, {_T} AS threshold, CASE WHEN metric = 'p_value' THEN 'at-most' ELSE 'at-least' END AS direction FROM signal"))
def thresholds(spark, sf):
    return C.with_thresholds(relation(spark, sf, "signal")).select("metric", "threshold", "direction").distinct()


@query("signal_overridden_thresholds", oracle(f"SELECT DISTINCT source, method, CASE WHEN method = 'selection' THEN 0.7 WHEN method = 'mixture' THEN 1.5 ELSE {_T} END::DOUBLE AS threshold FROM signal"))
def overrides(spark, sf):
    over = spark.createDataFrame([("grid", "selection", 0.7), (None, "selection", 0.8), (None, "mixture", 1.5)], "source string, method string, threshold double")
    return C.with_overrides(C.with_thresholds(relation(spark, sf, "signal")), over).select("source", "method", "threshold").distinct()


def _called(spark, sf):
    rows = C.with_thresholds(C.finite(relation(spark, sf, "signal")))
    return rows.withColumn("call", C.passes(F.col("value"), F.col("threshold"), F.col("direction")))


@query("signal_calls", oracle(f"SELECT dataset, metric, COUNT(*) AS n, COUNT(*) FILTER ({_PASS}) AS called FROM signal GROUP BY dataset, metric"))
def calls(spark, sf):
    return _called(spark, sf).groupBy("dataset", "metric").agg(F.count(F.lit(1)).alias("n"), F.count_if("call").alias("called"))


@query("signal_preferred", oracle("SELECT DISTINCT dataset, source, method, metric FROM signal"))
def preferred(spark, sf):
    return C.preferred_signal(relation(spark, sf, "signal"), ["posterior", "omega"])


_PAIRS = "p AS (SELECT a.dataset, a.metric AS a, b.metric AS b, a.key, a.value AS x, b.value AS y FROM signal a JOIN signal b ON a.dataset = b.dataset AND a.key = b.key AND a.metric < b.metric)"


@query("signal_pairs", oracle(f"WITH {_PAIRS} SELECT dataset, a, b, key, round(x, 6) AS x, round(y, 6) AS y FROM p"))
def pairs(spark, sf):
    return rounded(C.pair_join(relation(spark, sf, "signal")))


@query("signal_correlation_matrix", oracle(f"WITH {_PAIRS} SELECT dataset, a, b, COUNT(*) AS n, round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 6) AS pearson FROM p GROUP BY dataset, a, b"))
def correlation(spark, sf):
    return rounded(C.correlation_matrix(C.pair_join(relation(spark, sf, "signal"))))


@query("signal_correlation_degenerate", oracle("SELECT dataset, COUNT(*) AS n, NULL::DOUBLE AS pearson FROM signal WHERE metric = 'omega' GROUP BY dataset"))
def degenerate(spark, sf):
    rows = relation(spark, sf, "signal").filter("metric = 'omega'").withColumn("flat", F.lit(1.0))
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), C.pearson("value", "flat").alias("pearson"))


@query("signal_spearman", oracle(f"""WITH {_PAIRS}, r AS (SELECT dataset, a, b, rank() OVER (PARTITION BY dataset, a, b ORDER BY x) + (COUNT(*) OVER (PARTITION BY dataset, a, b, x) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY dataset, a, b ORDER BY y) + (COUNT(*) OVER (PARTITION BY dataset, a, b, y) - 1) / 2.0 AS ry FROM p)
    SELECT dataset, a, b, COUNT(*) AS n, round(covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)), 6) AS spearman FROM r GROUP BY dataset, a, b"""))
def spearman(spark, sf):
    return rounded(C.spearman(C.pair_join(relation(spark, sf, "signal")), ["dataset", "a", "b"]))


_CALLS = f"k AS (SELECT dataset, metric, key, {_PASS} AS call FROM signal), c AS (SELECT a.dataset, a.metric AS a, b.metric AS b, a.call AS x, b.call AS y FROM k a JOIN k b ON a.dataset = b.dataset AND a.key = b.key AND a.metric < b.metric)"


def _agreement(none: str) -> str:
    return oracle(f"""WITH {_CALLS} SELECT dataset, a, b, round(CASE WHEN COUNT(*) FILTER (x OR y) > 0 THEN COUNT(*) FILTER (x AND y)::DOUBLE / COUNT(*) FILTER (x OR y) ELSE {none} END, 6) AS jaccard, round(avg((x = y)::INT), 6) AS overall FROM c GROUP BY dataset, a, b""")


def _call_pairs(spark, sf):
    k = _called(spark, sf).select("dataset", "metric", "key", F.col("call").alias("value"))
    return C.pair_join(k)


@query("signal_agreement", _agreement("1.0"))
def agreement(spark, sf):
    return rounded(C.agreement(_call_pairs(spark, sf), ["dataset", "a", "b"]))


@query("signal_agreement_null_when_none", _agreement("NULL::DOUBLE"))
def agreement_null(spark, sf):
    return rounded(C.agreement(_call_pairs(spark, sf), ["dataset", "a", "b"], None))


@query("signal_wide", oracle("SELECT dataset, key, round(MAX(value) FILTER (metric = 'posterior'), 6) AS posterior, round(MAX(value) FILTER (metric = 'omega'), 6) AS omega FROM signal GROUP BY dataset, key"))
def wide(spark, sf):
    return rounded(C.wide(relation(spark, sf, "signal"), ["posterior", "omega"]))


@query("signal_catalog", oracle("SELECT source, method, metric, COUNT(*) AS observations, COUNT(DISTINCT dataset) AS datasets, round(MIN(value), 6) AS least, round(MAX(value), 6) AS most FROM signal GROUP BY 1, 2, 3"))
def catalog(spark, sf):
    return rounded(C.catalog(relation(spark, sf, "signal")))


@query("signal_scopes", oracle("SELECT dataset, source, COUNT(*) AS n, round(avg(value), 6) AS mean FROM signal GROUP BY 1, 2 UNION ALL SELECT dataset, 'all', COUNT(*), round(avg(value), 6) FROM signal GROUP BY dataset"))
def scopes(spark, sf):
    return rounded(C.scopes(relation(spark, sf, "signal")))


@query("signal_replicates", oracle("SELECT metric, COUNT(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS q90, round(quantile_cont(value, 0.95), 6) AS q95 FROM signal GROUP BY metric"))
def replicates(spark, sf):
    return rounded(C.replicate_summary(relation(spark, sf, "signal"), ["metric"], "value"))


@query("truth_confusion", oracle("""WITH n AS (SELECT COUNT(*) FILTER (l AND c) AS tp, COUNT(*) FILTER (NOT l AND c) AS fp, COUNT(*) FILTER (l AND NOT c) AS fn, COUNT(*) FILTER (NOT l AND NOT c) AS tn FROM (SELECT label = 1 AS l, score >= 0.5 AS c FROM truth))
    SELECT 'all' AS scope, tp, fp, fn, tn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(tn::DOUBLE / (tn + fp), 6) AS specificity, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy FROM n"""))
def confusion(spark, sf):
    rows = relation(spark, sf, "truth").withColumn("scope", F.lit("all"))
    return rounded(C.confusion(rows, ["scope"], F.col("label") == 1, F.col("score") >= 0.5))


@query("truth_roc_auc", oracle("""WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM truth), n AS (SELECT SUM(label) AS p, SUM(1 - label) AS q, SUM(r) FILTER (label = 1) AS s FROM r)
    SELECT 'all' AS scope, p::BIGINT AS positives, q::BIGINT AS negatives, round(((s - p * (p + 1) / 2.0) / (p * q))::DOUBLE, 6) AS auc FROM n"""))
def roc(spark, sf):
    return rounded(C.roc_auc(relation(spark, sf, "truth").withColumn("scope", F.lit("all")), ["scope"], "label", "score"))


@query("truth_average_precision", oracle("""WITH r AS (SELECT label, (SUM(label) OVER w)::DOUBLE / row_number() OVER w AS at FROM truth WINDOW w AS (ORDER BY score DESC, site ROWS UNBOUNDED PRECEDING)) SELECT 'all' AS scope, round(avg("at"), 6) AS average_precision FROM r WHERE label = 1"""))
def average_precision(spark, sf):
    return rounded(C.average_precision(relation(spark, sf, "truth").withColumn("scope", F.lit("all")), ["scope"], "label", "score", "site"))


@query("truth_binary_metrics", oracle("""WITH n AS (SELECT COUNT(*) FILTER (l = 1 AND c) AS tp, COUNT(*) FILTER (l = 0 AND c) AS fp, COUNT(*) FILTER (l = 1 AND NOT c) AS fn, avg((s - l) * (s - l)) AS brier FROM (SELECT label AS l, score AS s, score >= 0.8 AS c FROM truth))
    SELECT 'all' AS scope, tp, fp, fn, round(brier, 6) AS brier, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall FROM n"""))
def binary_metrics(spark, sf):
    return rounded(C.binary_metrics(relation(spark, sf, "truth").withColumn("scope", F.lit("all")), ["scope"], "label", "score", 0.8))


@query("scalar_tails", """SELECT s_suppkey, round(CASE WHEN x <= 0 THEN 1.0 ELSE exp(-x / 2) END, 6) AS tail2, round(ln(1 + exp(x)), 6) AS softplus, round(1 / (1 + exp(-x)), 6) AS logistic FROM (SELECT s_suppkey, (s_suppkey % 17 - 5)::DOUBLE / 2 AS x FROM supplier)""")
def tails(spark, sf):
    x = (F.col("s_suppkey") % 17 - 5) / 2.0
    rows = table(spark, sf, "supplier").select("s_suppkey", x.alias("x"))
    return rounded(rows.select("s_suppkey", S.chi2_tail_2(F.col("x")).alias("tail2"), S.log_add(F.lit(0.0), F.col("x")).alias("softplus"), S.logistic(F.col("x")).alias("logistic")))


_ERFC_T = "(1 / (1 + 0.5 * abs(x)))"


def _erfc_sql() -> str:
    poly = str(S.ERFC[-1])
    for c in reversed(S.ERFC[:-1]):
        poly = f"({poly}) * t + ({c})"
    return f"SELECT *, CASE WHEN x >= 0 THEN t * exp(-x * x + {poly}) ELSE 2 - t * exp(-x * x + {poly}) END AS e FROM (SELECT *, {_ERFC_T}::DOUBLE AS t FROM v)"


@query("scalar_erfc", f"WITH v AS (SELECT s_suppkey, (s_suppkey % 41 - 20)::DOUBLE / 10 AS x FROM supplier) SELECT s_suppkey, round(x, 6) AS x, round(e, 6) AS erfc FROM ({_erfc_sql()})")
def erfc(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 41 - 20) / 10.0).alias("x"))
    return rounded(rows.withColumn("erfc", S.erfc(F.col("x"))))


@query("branch_test_p", f"WITH w AS (SELECT s_suppkey, (s_suppkey % 30 - 4)::DOUBLE / 3 AS lrt FROM supplier), v AS (SELECT *, sqrt(greatest(lrt, 0) / 2) AS x FROM w) SELECT s_suppkey, round(CASE WHEN lrt <= 0 THEN 0.5 ELSE least(0.5, 0.05 * e + 0.45 * exp(-lrt / 2)) END, 6) AS p FROM ({_erfc_sql()})")
def branch_test(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 30 - 4) / 3.0).alias("lrt"))
    return rounded(rows.select("s_suppkey", S.branch_test_p(F.col("lrt")).alias("p")))


@query("one_sided_p", f"WITH w AS (SELECT s_suppkey, (s_suppkey % 30 - 4)::DOUBLE / 3 AS lrt, (s_suppkey % 3 - 1)::INT AS d FROM supplier), v AS (SELECT *, sqrt(greatest(lrt, 0) / 2) AS x FROM w), q AS (SELECT s_suppkey, CASE WHEN lrt <= 0 OR d = 0 THEN 0.5 WHEN d > 0 THEN e / 2 ELSE 1 - e / 2 END AS p FROM ({_erfc_sql()})) SELECT s_suppkey, round(p, 6) AS p_positive, round(1 - p, 6) AS p_purifying FROM q")
def one_sided(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 30 - 4) / 3.0).alias("lrt"), (F.col("s_suppkey") % 3 - 1).alias("d"))
    p, q = S.one_sided(F.col("lrt"), F.col("d"))
    return rounded(rows.select("s_suppkey", p.alias("p_positive"), q.alias("p_purifying")))


@query("information_criteria", """SELECT s_suppkey, round(2 * k - 2 * l, 6) AS aic, round(CASE WHEN n - k - 1 > 0 THEN 2 * k - 2 * l + 2 * k * (k + 1)::DOUBLE / (n - k - 1) ELSE 1e300 END, 6) AS aicc, round(k * ln(n) - 2 * l, 6) AS bic
    FROM (SELECT s_suppkey, -(s_suppkey * 7 % 100)::DOUBLE AS l, 3 + s_suppkey % 9 AS k, 10 + s_suppkey % 20 AS n FROM supplier)""")
def criteria(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", (-(F.col("s_suppkey") * 7 % 100)).cast("double").alias("l"), (3 + F.col("s_suppkey") % 9).alias("k"), (10 + F.col("s_suppkey") % 20).alias("n"))
    ic = {k: S.information_criterion(k, F.col("l"), F.col("k"), F.col("n")) for k in ("aic", "aicc", "bic")}
    return rounded(rows.select("s_suppkey", ic["aic"].cast("double").alias("aic"), F.least(ic["aicc"], F.lit(1e300)).alias("aicc"), ic["bic"].alias("bic")))


@query("guarded_ratios", "SELECT o_orderkey, round(CASE WHEN d > 0 AND n >= 0 THEN n / d END, 6) AS ratio, round(CASE WHEN n > 0 THEN ln(n) END, 6) AS log_n FROM (SELECT o_orderkey, (o_orderkey % 7 - 1)::DOUBLE AS n, (o_custkey % 5 - 1)::DOUBLE AS d FROM orders)")
def guarded(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 - 1).cast("double").alias("n"), (F.col("o_custkey") % 5 - 1).cast("double").alias("d"))
    return rounded(rows.select("o_orderkey", S.guarded_ratio(F.col("n"), F.nullif("d", F.lit(0.0))).alias("ratio"), S.guarded_log(F.col("n")).alias("log_n")))


@query("log_one_minus_exp", "SELECT s_suppkey, round(ln(1 - exp(x)), 6) AS v FROM (SELECT s_suppkey, -(1 + s_suppkey % 30)::DOUBLE / 10 AS x FROM supplier)")
def log1mexp(spark, sf):
    return rounded(table(spark, sf, "supplier").select("s_suppkey", S.log1mexp(-(1 + F.col("s_suppkey") % 30) / 10.0).alias("v")))


@query("fixation_rates", "SELECT s_suppkey, round(CASE WHEN d = 0 THEN 1.0 ELSE d / (1 - exp(-d)) END, 6) AS rate FROM (SELECT s_suppkey, (s_suppkey % 21 - 10)::DOUBLE / 4 AS d FROM supplier)")
def fixation(spark, sf):
    return rounded(table(spark, sf, "supplier").select("s_suppkey", S.fixation_rate((F.col("s_suppkey") % 21 - 10) / 4.0).alias("rate")))


@query("triplet_ranks", "SELECT a, b, c, (row_number() OVER (ORDER BY a, b, c) - 1)::BIGINT AS rank FROM (SELECT unnest(range(9))::INT AS a), (SELECT unnest(range(9))::INT AS b), (SELECT unnest(range(9))::INT AS c) WHERE a < b AND b < c")
def triplet_ranks(spark, sf):
    n = spark.range(9).select(F.col("id").cast("int").alias("v"))
    rows = n.withColumnRenamed("v", "a").join(n.withColumnRenamed("v", "b"), F.col("a") < F.col("b")).join(n.withColumnRenamed("v", "c"), F.col("b") < F.col("c"))
    return rows.select("a", "b", "c", S.combination_rank(F.col("a"), F.col("b"), F.col("c"), F.lit(9)).alias("rank"))


@query("third_taxon", "SELECT a, b, (h2 % 11)::INT AS c FROM (SELECT a, b, (((a + 1)::BIGINT * 73856093 + (b + 1)::BIGINT * 19349663) % 4294967296 * 69069 + 1) % 4294967296 AS h2 FROM (SELECT unnest(range(11))::INT AS a), (SELECT unnest(range(11))::INT AS b) WHERE a < b)")
def third(spark, sf):
    n = spark.range(11).select(F.col("id").cast("int").alias("v"))
    rows = n.withColumnRenamed("v", "a").join(n.withColumnRenamed("v", "b"), F.col("a") < F.col("b"))
    return rows.select("a", "b", S.third_taxon(F.col("a"), F.col("b"), 11).alias("c"))


@query("text_safe_names", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS name FROM part")
def safe_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.safe_name(F.col("p_name")).alias("name"))


@query("text_csv_cells", """SELECT event_id, CASE WHEN regexp_matches(props, '[",\\r\\n]') THEN '"' || replace(props, '"', '""') || '"' ELSE COALESCE(props, '') END AS cell FROM events""")
def csv_cells(spark, sf):
    return table(spark, sf, "events").select("event_id", S.csv_cell(F.col("props")).alias("cell"))


@query("text_newick_names", "SELECT c_custkey, '''' || replace(c_name, '''', '''''') || '''' AS name FROM customer")
def newick_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.newick_name(F.col("c_name")).alias("name"))


@query("text_insertion_suffix", "SELECT n::INT AS n, CASE WHEN n <= 26 THEN chr((64 + n)::INT) ELSE chr((64 + (n - 1) // 26)::INT) || chr((65 + (n - 1) % 26)::INT) END AS suffix FROM (SELECT unnest(range(1, 703)) AS n)")
def suffixes(spark, sf):
    return spark.range(1, 703).select(F.col("id").cast("int").alias("n"), S.insertion_suffix(F.col("id")).alias("suffix"))


@query("text_tags", r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<(h[1-6]|p|div|nav)\b', 1))), ',') AS tags FROM pages")
def tags(spark, sf):
    found = F.sort_array(F.array_distinct(F.regexp_extract_all("html", F.lit(r"<(h[1-6]|p|div|nav)\b"), F.lit(1))))
    return table(spark, sf, "pages").select("page_id", F.array_join(found, ",").alias("tags"))


@query("share_link_codec", "SELECT event_id, replace(replace(rtrim(to_base64(encode(props)), '='), '+', '-'), '/', '_') AS link FROM events")
def share_links(spark, sf):
    return table(spark, sf, "events").select("event_id", F.rtrim(F.translate(F.base64(F.regexp_replace("props", "^$", "").cast("binary")), "+/\r\n", "-_"), F.lit("=")).alias("link"))


@query("job_latest_state", "SELECT user_id, event_type AS state, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark, sf):
    best = table(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("state"), F.col("b.event_id").alias("event_id"))


@query("file_pair_status", """WITH a AS (SELECT lower(n_name) AS stem, COUNT(*) AS n FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY 1), b AS (SELECT lower(n_name) AS stem FROM nation UNION ALL SELECT lower(n_name) FROM nation WHERE n_nationkey % 6 = 1), c AS (SELECT stem, COUNT(*) AS n FROM b GROUP BY stem)
    SELECT a.stem, CASE WHEN c.n IS NULL THEN 'missing' WHEN c.n > 1 OR a.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM a LEFT JOIN c USING (stem)""")
def file_pairs(spark, sf):
    from ..sources.files import pair_by_stem

    n = table(spark, sf, "nation")
    alignments = n.filter("n_nationkey % 4 <> 0").select(F.concat(F.lit("in/"), "n_name", F.lit(".fasta")).alias("path"))
    trees = n.select(F.concat(F.lit("in/"), F.lower("n_name"), F.lit(".nwk")).alias("path")).unionByName(n.filter("n_nationkey % 6 = 1").select(F.concat(F.lit("more/"), "n_name", F.lit(".tree")).alias("path")))
    return pair_by_stem(alignments, trees).select("stem", "status")


@query("job_progress", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY ALL")
def job_progress(spark, sf):
    from ..streaming.jobs import windowed_progress

    return rounded(windowed_progress(table(spark, sf, "events")), 4)


@query("job_sessions", """WITH s AS (SELECT user_id, ts, COALESCE(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true) AS opens FROM events),
    g AS (SELECT user_id, ts, SUM(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT MIN(ts) AS start, MAX(ts) + INTERVAL 30 MINUTE AS "end", user_id, COUNT(*) AS n FROM g GROUP BY user_id, k""")
def job_sessions(spark, sf):
    from ..streaming.jobs import sessions

    return sessions(table(spark, sf, "events"))
