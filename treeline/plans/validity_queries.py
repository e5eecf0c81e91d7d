"""What must hold of results that SQL can't express: each query looks at the whole result of another and gives what the oracle derives from the tables."""

from __future__ import annotations

from pyspark.sql import Window

from ..relations import TAXA
from . import alignment_queries, analysis_queries
from .helpers import F, oracle, query, relation

_WIDE = alignment_queries._COUNTS


@query("joined_tree_tips", oracle("SELECT DISTINCT 't' || taxon AS name, true AS at_tip, true AS lengths FROM aln"))
def joined_tree_tips(spark, sf):
    """The tips of the neighbour-joining tree of all taxa, and that no branch is shorter than 0."""
    from ..operators.site_models import joined_tree
    from ..sources.parsers import parse_newick

    rows, todo = [], [parse_newick(joined_tree(relation(spark, sf, "aln"), TAXA))]
    fine = True
    while todo:
        node = todo.pop()
        fine &= (node.length or 0.0) >= 0
        todo += node.children
        if node.name:
            rows.append((node.name, not node.children))
    return spark.createDataFrame(rows, "name string, at_tip boolean").withColumn("lengths", F.lit(fine))


@query("recombination_signals_valid", oracle(f"""WITH {alignment_queries._EVENTS}, n AS (SELECT *, {_WIDE} FROM v WINDOW lw AS (PARTITION BY a, b, c ORDER BY event ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
      rw AS (PARTITION BY a, b, c ORDER BY event ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
    g AS (SELECT *, CASE WHEN l0 + l1 + l2 = 10 AND r0 + r1 + r2 = 10 THEN round({alignment_queries._G}, 9) END AS g FROM n),
    p AS (SELECT *, COALESCE(g >= COALESCE(lag(g) OVER w, 0.0) AND g > COALESCE(lead(g) OVER w, 0.0), false) AS peak FROM g WINDOW w AS (PARTITION BY a, b, c ORDER BY event))
    SELECT a, b, c, COUNT(*) AS signals, round(SUM(g), 4) AS g, true AS placed, true AS p_values FROM p WHERE peak AND g >= 4 GROUP BY a, b, c"""))
def signals_valid(spark, sf):
    """Refined signals of each triplet: one for each strong peak of its scan, within its interval, which is within the sites, with p values that follow from g."""
    found, sites = analysis_queries._refined(spark, sf)
    within = F.col("breakpoint").between(F.col("interval_low"), F.col("interval_high")) & (F.col("interval_low") >= 1) & (F.col("interval_high") <= sites - 1)
    placed = F.coalesce(within & F.col("switch").between(0, 1), F.lit(False))
    p = (F.abs(F.col("raw_p") - F.exp(-F.col("g") / 2)) < 1e-9) & (F.col("adjusted_p") >= F.col("raw_p") - 1e-12) & (F.col("adjusted_p") <= 1)
    return found.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("signals"), F.round(F.sum("g"), 4).alias("g"), F.bool_and(placed).alias("placed"), F.bool_and(p).alias("p_values"))


@query("recombination_consensus_valid", oracle("SELECT true AS spaced, true AS inside, true AS ranked, true AS paid"))
def consensus_valid(spark, sf):
    """Consensus breakpoints: 15 sites apart and from the ends, ranked by score without gaps, each worth its penalty."""
    from ..operators.chains import kept
    from ..operators.signals import merged

    signals, sites = analysis_queries._refined(spark, sf)
    found = kept(merged(signals, sites))
    # two that are too near are in one bin of 15 sites or in neighbouring ones
    place = found.select(F.col("breakpoint").alias("x"), F.floor(F.col("breakpoint") / 15).alias("bin"))
    after = place.select(F.col("x").alias("y"), F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin"))
    near = place.join(after, "bin").filter("x < y AND y - x < 15").agg((F.count(F.lit(1)) == 0).alias("spaced"))
    own = found.agg(
        F.coalesce(F.bool_and(F.col("breakpoint").between(15, sites - 15)), F.lit(True)).alias("inside"),
        (F.count(F.lit(1)) == F.coalesce(F.max("rank"), F.lit(0))).alias("ranked"), F.coalesce(F.bool_and(F.col("score") > 2.5), F.lit(True)).alias("paid"),
    )
    return near.crossJoin(own)


@query("recombination_cuts_valid", oracle("SELECT true AS few, true AS inside, true AS different"))
def cuts_valid(spark, sf):
    """Cuts for trees: twelve at most, 30 sites from both ends, no two at one place."""
    found = analysis_queries.cuts(spark, sf)
    sites = relation(spark, sf, "aln").agg(F.max("site")).first()[0] or 0
    return found.agg((F.count(F.lit(1)) <= 12).alias("few"), F.coalesce(F.bool_and(F.col("breakpoint").between(30, sites - 30)), F.lit(True)).alias("inside"), (F.countDistinct("breakpoint") == F.count(F.lit(1))).alias("different"))


@query("recombination_retained_states_valid", oracle("SELECT 1 AS first, MAX(site) AS last, true AS whole, true AS long, true AS changes FROM emission"))
def retained_valid(spark, sf):
    """Segments of the retained states: they cover all sites in order, none is shorter than ten, neighbours differ."""
    found = analysis_queries.retained_states(spark, sf)
    w = Window.partitionBy("dataset").orderBy("start")
    step = found.withColumn("gap", F.col("start") - F.coalesce(F.lag("end").over(w), F.lit(0)) - 1).withColumn("same", F.coalesce(F.col("state") == F.lag("state").over(w), F.lit(False)))
    return step.agg(F.min("start").alias("first"), F.max("end").alias("last"), F.bool_and(F.col("gap") == 0).alias("whole"), F.bool_and(F.col("end") - F.col("start") + 1 >= 10).alias("long"), F.bool_and(~F.col("same")).alias("changes"))


@query("profile_alignment_chains", oracle("SELECT DISTINCT taxon::VARCHAR AS chain, true AS scored FROM codons"))
def profile_chains(spark, sf):
    """Every chain is aligned with the profile once; a local alignment never scores below 0."""
    found = analysis_queries.profile_alignment(spark, sf)
    return found.groupBy("chain").agg(((F.count(F.lit(1)) == 1) & F.bool_and(F.col("score") >= 0)).alias("scored"))
