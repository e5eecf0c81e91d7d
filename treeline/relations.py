"""The domain relations, derived from the driver's tables by expressions that Spark and DuckDB share.

Each relation has a DataFrame builder here and, for the oracles, the same definition as SQL in
``RELATION_SQL``. All arithmetic that must agree bit for bit is on integers. Sites, keys, chains and
regions grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import TABLES, table

#: Taxa of the derived alignment.
TAXA = 8


def _sites(spark: SparkSession, sf_dir: str, orders: int) -> DataFrame:
    """site from 0 on, one for every so many orders."""
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey").alias("last"))
    return last.select(F.explode(F.sequence(F.lit(0), F.expr(f"int(last div {orders})"))).alias("site"))


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxon, site (1-based), base (0..3; null is a gap)."""
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % TAXA).cast("int").alias("taxon"), F.expr("int(l_orderkey div 5 + 1)").alias("site"))
        .agg(F.sum("l_partkey").alias("p"), F.sum("l_linenumber").alias("n"))
    )
    return cells.select("taxon", "site", F.when(F.col("n") % 11 != 0, (F.col("p") % 4).cast("int")).alias("base"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxon, site, letter of the full matrix, gaps as '-'."""
    grid = spark.range(TAXA).select(F.col("id").cast("int").alias("taxon")).crossJoin(_sites(spark, sf_dir, 5).select((F.col("site") + 1).alias("site")))
    letter = F.coalesce(F.substring(F.lit("ACGT"), F.col("base") + 1, F.lit(1)), F.lit("-"))
    return grid.join(aln(spark, sf_dir), ["taxon", "site"], "left").select("taxon", "site", letter.alias("letter"), "base")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxon, name, sequence."""
    ordered = F.array_sort(F.collect_list(F.struct("site", "letter")))
    joined = F.array_join(F.transform(ordered, lambda x: x["letter"]), "")
    return cells(spark, sf_dir).groupBy("taxon").agg(joined.alias("sequence")).select("taxon", F.concat(F.lit("t"), F.col("taxon")).alias("name"), "sequence")


def codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxon, codon_site (1-based), codon (three letters)."""
    ordered = F.array_sort(F.collect_list(F.struct("site", "letter")))
    site = F.expr("int((site - 1) div 3 + 1)")
    return cells(spark, sf_dir).groupBy("taxon", site.alias("codon_site")).agg(F.array_join(F.transform(ordered, lambda x: x["letter"]), "").alias("codon"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, parent_id, name, length, depth: root, regions, nations (tips)."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    length = lambda key: (1 + key % 7) / F.lit(10.0)
    root = spark.range(1).select(F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit("root").alias("name"), F.lit(0.0).alias("length"), F.lit(0).alias("depth"))
    inner = region.select((1 + F.col("r_regionkey")).alias("node_id"), F.lit(0).alias("parent_id"), F.col("r_name").alias("name"), length(F.col("r_regionkey")).alias("length"), F.lit(1).alias("depth"))
    tips = nation.select((100 + F.col("n_nationkey")).alias("node_id"), (1 + F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("name"), length(F.col("n_nationkey")).alias("length"), F.lit(2).alias("depth"))
    return root.unionByName(inner).unionByName(tips)


def clades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id, clade, tip: two groupings of the nations, by region and by key."""
    nation = table(spark, sf_dir, "nation")
    one = nation.select(F.lit("A").alias("tree_id"), F.col("n_regionkey").alias("clade"), F.col("n_name").alias("tip"))
    two = nation.select(F.lit("B").alias("tree_id"), F.when(F.col("n_nationkey") < 10, F.col("n_regionkey")).otherwise(F.col("n_nationkey") % 3).alias("clade"), F.col("n_name").alias("tip"))
    return one.unionByName(two)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category, alpha_idx, beta_idx, alpha, beta: the 5 x 5 transformed grid, alpha-major."""
    from .operators.grids import selection_grid

    return selection_grid(spark, 5)


def lik_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site (from 0), logl: the 25 categories of a site in one array; a cell without rows is at the floor."""
    cell = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.expr("int(l_orderkey div 8)").alias("site"), ((F.col("l_partkey") % 5) * 5 + F.col("l_suppkey") % 5).cast("int").alias("category"))
        .agg((-F.sum(F.col("l_quantity").cast("long")) / F.lit(100.0)).alias("logl"))
    )
    held = cell.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("category", "logl"))).alias("held"))
    value = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda c: F.greatest(F.coalesce(F.try_element_at("held", c), F.lit(-9.0)), F.lit(-60.0)))
    return _sites(spark, sf_dir, 8).join(held, "site", "left").select("site", value.alias("logl"))


def lik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site (from 0), category (0..24), logl."""
    return lik_sites(spark, sf_dir).select("site", F.posexplode("logl").alias("category", "logl"))


def emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id (0..3), site (1-based), logl."""
    cell = (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % 4).cast("int").alias("tree_id"), F.expr("int(l_orderkey div 12 + 1)").alias("site"))
        .agg((-(F.sum("l_partkey") % 97) / F.lit(40.0)).alias("logl"))
    )
    full = spark.range(4).select(F.col("id").cast("int").alias("tree_id")).crossJoin(_sites(spark, sf_dir, 12).select((F.col("site") + 1).alias("site")))
    return full.join(cell, ["tree_id", "site"], "left").select("tree_id", "site", F.coalesce("logl", F.lit(-1.0)).alias("logl"))


def region_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start, end (inclusive, 1-based), tree_id: an ordered cover of the alignment's sites by runs of 30."""
    run = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("k"), (F.col("s_nationkey") % 5).alias("t"))
    return run.select((30 * F.col("k") + 1).alias("start"), (30 * F.col("k") + 30).alias("end"), F.concat(F.lit("T"), F.col("t")).alias("tree_id"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, source, method, metric, key, value: three metrics by customer group and market segment."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    base = joined.groupBy(F.col("c_mktsegment").alias("dataset"), F.expr("int(c_custkey div 4)").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("o_orderkey") % 101).cast("long")).alias("a"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f")
    )
    stack = F.explode(
        F.array(
            F.struct(F.lit("grid").alias("source"), F.lit("selection").alias("method"), F.lit("posterior").alias("metric"), (F.col("f") / F.col("n")).alias("value")),
            F.struct(F.lit("grid").alias("source"), F.lit("ratio_test").alias("method"), F.lit("p_value").alias("metric"), ((F.col("a") % 50) / F.lit(50.0)).alias("value")),
            F.struct(F.lit("scan").alias("source"), F.lit("mixture").alias("method"), F.lit("omega").alias("metric"), ((F.col("a") % 97) / F.lit(40.0)).alias("value")),
        )
    )
    return base.select("dataset", "key", stack.alias("s")).select("dataset", "s.source", "s.method", "s.metric", "key", "s.value")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site (doc_id), label, score, p: labelled rows with a score to judge."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id")
    return joined.select(F.col("doc_id").alias("site"), F.col("quality").alias("label"), ((F.col("n_chars") % 211) / F.lit(211.0)).alias("score"), ((F.col("n_chars") % 103) / F.lit(103.0)).alias("p"))


def events_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, pos (1-based), state (0..3): event types of each user in time order."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    chain = F.col("user_id").cast("int")
    order = Window.partitionBy(chain).orderBy("ts", "event_id")
    return events.select(chain.alias("chain"), F.row_number().over(order).alias("pos"), F.expr("int(length(event_type) % 4)").alias("state"))


RELATIONS = {f.__name__: f for f in (aln, cells, sequences, codons, tree, clades, grid, lik, emission, region_runs, signal, truth, events_chain)}

RELATION_SQL = {
    "aln": """SELECT taxon, site, CASE WHEN n % 11 <> 0 THEN (p % 4)::INT END AS base FROM (
        SELECT (l_suppkey % 8)::INT AS taxon, (l_orderkey // 5 + 1)::INT AS site, SUM(l_partkey)::BIGINT AS p, SUM(l_linenumber)::BIGINT AS n
        FROM lineitem GROUP BY ALL)""",
    "cells": """SELECT t.taxon, s.site, COALESCE(substr('ACGT', a.base + 1, 1), '-') AS letter, a.base
        FROM (SELECT unnest(range(8))::INT AS taxon) t CROSS JOIN (SELECT unnest(range(1, (SELECT MAX(l_orderkey) // 5 + 2 FROM lineitem)))::INT AS site) s
        LEFT JOIN aln a ON a.taxon = t.taxon AND a.site = s.site""",
    "sequences": "SELECT taxon, 't' || taxon AS name, string_agg(letter, '' ORDER BY site) AS sequence FROM cells GROUP BY taxon",
    "codons": "SELECT taxon, ((site - 1) // 3 + 1)::INT AS codon_site, string_agg(letter, '' ORDER BY site) AS codon FROM cells GROUP BY 1, 2",
    "tree": """SELECT 0 AS node_id, NULL::INT AS parent_id, 'root' AS name, 0.0::DOUBLE AS length, 0 AS depth
        UNION ALL SELECT 1 + r_regionkey, 0, r_name, (1 + r_regionkey % 7) / 10.0::DOUBLE, 1 FROM region
        UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, n_name, (1 + n_nationkey % 7) / 10.0::DOUBLE, 2 FROM nation""",
    "clades": """SELECT 'A' AS tree_id, n_regionkey AS clade, n_name AS tip FROM nation
        UNION ALL SELECT 'B', CASE WHEN n_nationkey < 10 THEN n_regionkey ELSE n_nationkey % 3 END, n_name FROM nation""",
    "grid": """SELECT (a.i * 5 + b.i)::INT AS category, a.i AS alpha_idx, b.i AS beta_idx, a.v AS alpha, b.v AS beta
        FROM (SELECT i, greatest(power(10.0::DOUBLE, -1.3010299956639813 + i * 0.6505149978319906) - 0.05, 0.0)::DOUBLE AS v FROM (SELECT unnest(range(5))::INT AS i)) a
        CROSS JOIN (SELECT i, greatest(power(10.0::DOUBLE, -1.3010299956639813 + i * 0.6505149978319906) - 0.05, 0.0)::DOUBLE AS v FROM (SELECT unnest(range(5))::INT AS i)) b""",
    "lik": """SELECT s.site, c.category, greatest(COALESCE(k.logl, -9.0), -60.0)::DOUBLE AS logl
        FROM (SELECT unnest(range((SELECT MAX(l_orderkey) // 8 + 1 FROM lineitem)))::INT AS site) s CROSS JOIN (SELECT unnest(range(25))::INT AS category) c
        LEFT JOIN (SELECT (l_orderkey // 8)::INT AS site, ((l_partkey % 5) * 5 + l_suppkey % 5)::INT AS category,
                          -SUM(l_quantity::BIGINT)::BIGINT / 100.0::DOUBLE AS logl FROM lineitem GROUP BY 1, 2) k USING (site, category)""",
    "emission": """SELECT t.tree_id, s.site, COALESCE(k.logl, -1.0)::DOUBLE AS logl
        FROM (SELECT unnest(range(4))::INT AS tree_id) t CROSS JOIN (SELECT unnest(range(1, (SELECT MAX(l_orderkey) // 12 + 2 FROM lineitem)))::INT AS site) s
        LEFT JOIN (SELECT (l_suppkey % 4)::INT AS tree_id, (l_orderkey // 12 + 1)::INT AS site, -(SUM(l_partkey)::BIGINT % 97) / 40.0::DOUBLE AS logl
                   FROM lineitem GROUP BY 1, 2) k USING (tree_id, site)""",
    "region_runs": "SELECT (30 * s_suppkey + 1)::INT AS start, (30 * s_suppkey + 30)::INT AS \"end\", 'T' || (s_nationkey % 5) AS tree_id FROM supplier",
    "signal": """SELECT dataset, m.source, m.method, m.metric, key, m.value FROM (
        SELECT dataset, key, unnest([
          {'source': 'grid', 'method': 'selection', 'metric': 'posterior', 'value': f / n::DOUBLE},
          {'source': 'grid', 'method': 'ratio_test', 'metric': 'p_value', 'value': (a % 50) / 50.0::DOUBLE},
          {'source': 'scan', 'method': 'mixture', 'metric': 'omega', 'value': (a % 97) / 40.0::DOUBLE}]) AS m
        FROM (SELECT c_mktsegment AS dataset, (c_custkey // 4)::INT AS key, COUNT(*) AS n, SUM(o_orderkey % 101)::BIGINT AS a,
                     SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f
              FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2))""",
    "truth": """SELECT doc_id AS site, quality AS label, (n_chars % 211) / 211.0::DOUBLE AS score, (n_chars % 103) / 103.0::DOUBLE AS p
        FROM documents JOIN labels USING (doc_id)""",
    "events_chain": """SELECT user_id::INT AS chain, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS pos,
        (length(event_type) % 4)::INT AS state FROM events""",
}
_NEEDS = {"cells": ["aln"], "sequences": ["aln", "cells"], "codons": ["aln", "cells"]}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return RELATIONS[name](spark, sf_dir)


def oracle(body: str) -> str:
    """DuckDB SQL with a CTE for every relation that the body names."""
    names: list[str] = []
    for name in RELATION_SQL:
        if re.search(rf"\b{name}\b", body):
            names += [n for n in [*_NEEDS.get(name, []), name] if n not in names]
    ctes = ", ".join(f"{n} AS MATERIALIZED ({RELATION_SQL[n]})" for n in names)
    body = body.strip()
    if not ctes:
        return body
    if re.match(r"WITH RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {ctes}, {body[14:]}"
    return f"WITH {ctes}, {body[4:]}" if re.match(r"WITH\b", body, re.I) else f"WITH {ctes} {body}"


def with_views(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL in which the driver's tables and the relations can be named; no view is left behind."""
    used = {n: (RELATIONS[n](spark, sf_dir) if n in RELATIONS else table(spark, sf_dir, n)) for n in (*RELATIONS, *TABLES) if re.search(rf"\b{n}\b(?!\()", text)}
    for n in used:
        text = re.sub(rf"(\bFROM|\bJOIN)(\s+){n}\b", rf"\1\2{{{n}}}", text, flags=re.I)
    used = {n: df for n, df in used.items() if f"{{{n}}}" in text}
    return spark.sql(text, **used)
