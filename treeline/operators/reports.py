"""Result tables, bundles, handoffs and evaluation over regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import overlaps

BUNDLE = "struct<schemaVersion:int,sites:int,regions:array<struct<start:int,end:int,treeId:string>>,trees:array<struct<treeId:string,newick:string>>>"


def flatten_scalars(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names; arrays and maps are left out."""
    out: list[Column] = []

    def walk(schema: T.StructType, column: Column | None, prefix: str) -> None:
        for f in schema.fields:
            c = F.col(f"`{f.name}`") if column is None else column.getField(f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, c, f"{prefix}{f.name}.")
            elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(c.alias(prefix + f.name))

    walk(df.schema, None, "")
    return df.select(*out)


def call_columns(rows: DataFrame, threshold: float = 0.9, level: float = 0.05) -> DataFrame:
    """Calls by method: posteriors strictly above a threshold, adjusted p at or below a level."""
    posterior = F.col("method").isin("selection", "mixture") & (F.col("value") > threshold)
    p = (F.col("method") == "ratio_test") & (F.col("value") <= level)
    return rows.withColumn("called", F.coalesce(posterior | p, F.lit(False)))


def bundle(regions: DataFrame, trees: DataFrame, sites: int) -> DataFrame:
    """One JSON text with regions in order and their trees."""
    r = regions.agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("tree_id").alias("treeId")))).alias("regions"))
    t = trees.agg(F.array_sort(F.collect_list(F.struct(F.col("tree_id").alias("treeId"), "newick"))).alias("trees"))
    return r.crossJoin(t).select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit(sites).alias("sites"), "regions", "trees")).alias("bundle"))


def read_bundle(texts: DataFrame, sites: int) -> tuple[DataFrame, DataFrame]:
    """(regions with their trees, problems) of bundle texts: wrong version or length, gaps, overlaps, unknown trees."""
    parsed = texts.select(F.from_json("bundle", BUNDLE).alias("b"))
    regions = parsed.select("b.schemaVersion", F.col("b.sites").alias("total"), F.explode("b.regions").alias("r")).select("schemaVersion", "total", "r.start", "r.end", F.col("r.treeId").alias("tree_id"))
    trees = parsed.select(F.explode("b.trees").alias("t")).select(F.col("t.treeId").alias("tree_id"), "t.newick")
    w = Window.orderBy("start")
    step = F.col("start") - F.coalesce(F.lag("end").over(w), F.lit(0)) - 1
    bad = (
        regions.join(trees, "tree_id", "left").withColumn("step", step)
        .withColumn("problem", F.when(F.col("schemaVersion") != 1, "version").when(F.col("total") != sites, "sites").when(F.col("newick").isNull(), "tree").when(F.col("step") > 0, "gap").when(F.col("step") < 0, "overlap"))
    )
    return regions.join(trees, "tree_id").select("start", "end", "tree_id", "newick"), bad.filter("problem IS NOT NULL").select("start", "problem")


def site_truth_join(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Truth and inference on dataset and site where both have a value."""
    return truth.filter("label IS NOT NULL").join(found.filter("value IS NOT NULL"), ["dataset", "site"])


def rows_with_signals(rows: DataFrame, signals: DataFrame, key: str) -> DataFrame:
    """Result rows widened by signal columns; keys that only signals have come as new rows."""
    return rows.join(signals, key, "full")


def compatible(methods: DataFrame, sources: DataFrame, recombination: Column) -> DataFrame:
    """Pairs of method and source by accepted kinds; a true tree is refused if the data recombine and the method reads single trees."""
    joined = methods.withColumn("kind", F.explode("accepts")).join(sources, "kind")
    refused = (F.col("kind") == "true-tree") & recombination & ~F.col("regional")
    return joined.filter(~refused).select("method", "source", "kind")


def same_taxa(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: missing, extra and whether the sets of names are equal."""
    marked = a.select("name").distinct().withColumn("x", F.lit(1)).unionByName(b.select("name").distinct().withColumn("x", F.lit(2))).groupBy("name").agg(F.sum("x").alias("x"))
    n = marked.agg(F.count_if(F.col("x") == 1).alias("missing"), F.count_if(F.col("x") == 2).alias("extra"))
    return n.withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


def overlap_distance(a: DataFrame, b: DataFrame, distances: DataFrame) -> DataFrame:
    """Mean tree distance of two segmentations over the sites that they share: distances has a_id, b_id, rf."""
    met = overlaps(a, b).join(F.broadcast(distances), ["a_id", "b_id"])
    return met.agg((F.sum(F.col("shared") * F.col("rf")) / F.sum("shared")).alias("mean_rf"), F.sum("shared").alias("sites"))


def site_distance(per_site: DataFrame, taxa: int) -> DataFrame:
    """Mean halved distance over taxa - 3, and the share of sites with the right tree."""
    return per_site.agg(F.avg(F.col("rf") / 2 / (taxa - 3)).alias("mean_rf"), F.avg((F.col("rf") == 0).cast("double")).alias("exact"))


def recovery(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Mean absolute and root mean square error, correlation and slope of pair distances."""
    j = truth.select("a", "b", F.col("distance").alias("x")).join(found.select("a", "b", F.col("distance").alias("y")), ["a", "b"])
    e = F.col("y") - F.col("x")
    return j.agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.try_divide(F.covar_pop("x", "y"), F.sqrt(F.var_pop("x") * F.var_pop("y"))).alias("correlation"), F.try_divide(F.covar_pop("x", "y"), F.var_pop("x")).alias("slope"),
    )


def mass_expectation(rows: DataFrame, mass: str, values: list[float]) -> Column:
    """Expectation from an array of masses: a fold in one expression, no join."""
    v = F.array(*[F.lit(x) for x in values])
    return F.aggregate(F.zip_with(F.col(mass), v, lambda m, x: m * x), F.lit(0.0), lambda a, x: a + x) / F.aggregate(F.col(mass), F.lit(0.0), lambda a, x: a + x)


def logo(profile: DataFrame) -> DataFrame:
    """Letters of a column by falling height (frequency times its share of valid rows), stacked from the bottom."""
    h = profile.withColumn("height", F.col("frequency") * F.col("valid") / (F.col("valid") + F.col("missing")))
    order = Window.partitionBy("codon_site").orderBy("height", F.desc("aa")).rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("bottom", F.coalesce(F.sum("height").over(order), F.lit(0.0))).select("codon_site", "aa", "height", "bottom")


def hypotheses(rows: DataFrame, chosen: list[str], threshold: float) -> DataFrame:
    """site, hypothesis, value of chosen columns strictly above a threshold, from a map of each row."""
    m = F.create_map(*[x for c in chosen for x in (F.lit(c), F.col(c))])
    return rows.select("site", F.explode(m).alias("hypothesis", "value")).filter(F.col("value") > threshold)


def hotspots(sites: int, centres: DataFrame) -> DataFrame:
    """site, weight = 1 plus Gaussians of (centre, intensity, width)."""
    every = centres.sparkSession.range(1, sites).select(F.col("id").cast("int").alias("site"))
    u = (F.col("site") - F.col("centre")) / F.col("width")
    return every.crossJoin(F.broadcast(centres)).groupBy("site").agg((1 + F.sum(F.col("intensity") * F.exp(-0.5 * u * u))).alias("weight"))


def event_pool(moves: DataFrame, k: int) -> DataFrame:
    """Moves by total support, the best k."""
    total = moves.groupBy("move").agg(F.sum("support").alias("support"), F.count(F.lit(1)).alias("seen"))
    return total.orderBy(F.desc("support"), "move").limit(k)


def bit_transitions(path: DataFrame, bits: int, pseudo: float = 0.5) -> DataFrame:
    """bit, opened, closed rates of a mask path (chain, pos, mask): how often a clear bit is set next, and a set one cleared."""
    w = Window.partitionBy("chain").orderBy("pos")
    step = path.withColumn("next", F.lead("mask").over(w)).filter("next IS NOT NULL")
    each = step.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))).withColumn("x", F.expr("(mask >> bit) & 1")).withColumn("y", F.expr("(next >> bit) & 1"))
    n = lambda a, b: F.count_if((F.col("x") == a) & (F.col("y") == b))
    rate = lambda a, b: (n(a, b) + pseudo) / (n(a, b) + n(a, a) + 2 * pseudo)
    return each.groupBy("bit").agg(rate(0, 1).alias("opened"), rate(1, 0).alias("closed"))


def rate_bank(neighbors: DataFrame, grid: DataFrame, pi: DataFrame) -> DataFrame:
    """alpha, beta, from_codon, to_codon, rate of each different (alpha, beta) of a grid."""
    models = grid.select("alpha", "beta").distinct()
    to = pi.select("table_id", F.col("codon").alias("to_codon"), "pi")
    r = neighbors.join(F.broadcast(to), ["table_id", "to_codon"]).crossJoin(F.broadcast(models))
    return r.select("alpha", "beta", "from_codon", "to_codon", (F.when(F.col("synonymous"), F.col("alpha")).otherwise(F.col("beta")) * F.col("pi")).alias("rate"))


def latest(store: DataFrame, key: str, *order: str) -> DataFrame:
    """The last version of each record of an append-only store; deleted ones are gone."""
    best = store.groupBy(key).agg(F.max_by(F.struct(*store.columns), F.struct(*order)).alias("r")).select("r.*")
    return best.filter("NOT deleted") if "deleted" in store.columns else best


def spatial_top(rows: DataFrame, group: list[str], position: str, score: str, k: int, apart: float) -> DataFrame:
    """Half of k greedily apart in position, the rest by score."""
    import numpy as np
    import pandas as pd

    from ..kernels.hmm import suppress

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        p, s = frame[position].to_numpy(), frame[score].to_numpy()
        first = suppress(p, s, apart, (k + 1) // 2)
        rest = [i for i in np.lexsort((p, -s)) if i not in set(first)][: k - len(first)]
        return frame.iloc[[*first, *rest]].assign(reserved=[True] * len(first) + [False] * len(rest))

    schema = T.StructType([*rows.schema.fields, T.StructField("reserved", T.BooleanType())])
    return rows.groupBy(*group).applyInPandas(pick, schema)
