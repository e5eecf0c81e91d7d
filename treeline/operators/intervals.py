"""Joins of sites, codons and regions on inclusive, 1-based intervals.

A range join is turned into an equi-join on fixed bins, so no side is compared with all of the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import runs

BIN = 64


def _binned(runs_: DataFrame, width: int) -> DataFrame:
    return runs_.withColumn("_bin", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))))


def locate(points: DataFrame, at: str, regions: DataFrame, width: int = BIN) -> DataFrame:
    """Each point with every region that covers it."""
    p = points.withColumn("_bin", F.expr(f"{at} div {width}"))
    return p.join(_binned(regions, width), "_bin").filter(F.col(at).between(F.col("start"), F.col("end"))).drop("_bin")


def codons_to_regions(n_codons: int, regions: DataFrame) -> DataFrame:
    """codon runs (start_codon, end_codon, tree_id): a codon belongs to the region of its middle nucleotide; equal neighbours merge."""
    spark = regions.sparkSession
    points = spark.range(1, n_codons + 1).select(F.col("id").cast("int").alias("codon")).withColumn("middle", F.col("codon") * 3 - 1)
    found = locate(points, "middle", regions).withColumn("one", F.lit(1))
    return runs(found, ["one"], "codon", "tree_id").select(F.col("start").alias("start_codon"), F.col("end").alias("end_codon"), "tree_id")


def cover_check(regions: DataFrame) -> DataFrame:
    """start, end, gap, overlap against the region before: how many sites are missing or double."""
    step = F.col("start") - F.lag("end").over(Window.orderBy("start")) - 1
    return regions.withColumn("_s", F.coalesce(step, F.lit(0))).select("start", "end", F.greatest("_s", F.lit(0)).alias("gap"), F.greatest(-F.col("_s"), F.lit(0)).alias("overlap"))


def scatter(blocks: DataFrame, offsets: DataFrame) -> DataFrame:
    """Regional (region, site, category, logl) moved to their places in the whole."""
    return blocks.join(F.broadcast(offsets), "region").select((F.col("site") + F.col("offset")).alias("site"), "category", "logl")


def overlaps(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of regions (a_id, b_id) with the length that they share."""
    x = _binned(a, width).select(F.col("start").alias("as"), F.col("end").alias("ae"), F.col("tree_id").alias("a_id"), "_bin")
    y = _binned(b, width).select(F.col("start").alias("bs"), F.col("end").alias("be"), F.col("tree_id").alias("b_id"), "_bin")
    lo, hi = F.greatest("as", "bs"), F.least("ae", "be")
    # a pair meets in every bin that both touch; it counts in the first
    met = x.join(y, "_bin").filter((hi >= lo) & (F.col("_bin") == F.floor(lo / width)))
    return met.select("a_id", "b_id", "as", "bs", (hi - lo + 1).alias("shared"))


def family_windows(regions: DataFrame) -> DataFrame:
    """Segments, adjacent pairs and triplets of segments, and the whole."""
    w = Window.orderBy("start")
    with_next = regions.select("start", "end", F.lead("end", 1).over(w).alias("end2"), F.lead("end", 2).over(w).alias("end3"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(n).alias("rank"), F.col(c).alias("stop")) for n, (k, c) in enumerate((("segment", "end"), ("pair", "end2"), ("triplet", "end3")), 1)]))
    parts = with_next.select("start", kinds.alias("k")).select("start", F.col("k.stop").alias("end"), "k.label", "k.rank").filter("end IS NOT NULL")
    whole = regions.agg(F.min("start").alias("start"), F.max("end").alias("end")).select("start", "end", F.lit("global").alias("label"), F.lit(0).alias("rank"))
    return whole.unionByName(parts)


def overlap_windows(spark, sites: int, parts: int = 4) -> DataFrame:
    """Windows of a quarter of the sites that overlap by half."""
    size = max(1, sites // parts)
    stride = max(1, size // 2)
    starts = spark.range(1, sites - size + 2, stride)
    return starts.select(F.col("id").cast("int").alias("start"), (F.col("id") + size - 1).cast("int").alias("end"), F.lit("overlap").alias("label"), F.lit(4).alias("rank"))


def break_counts(breakpoints: DataFrame, sites: int) -> DataFrame:
    """site, breaks for every site: how many breakpoints come right after it."""
    n = breakpoints.groupBy(F.col("breakpoint").alias("site")).agg(F.count(F.lit(1)).alias("n"))
    every = breakpoints.sparkSession.range(1, sites + 1).select(F.col("id").cast("int").alias("site"))
    return every.join(n, "site", "left").select("site", F.coalesce("n", F.lit(0)).alias("breaks"))


def changed_splits(ordered: DataFrame, splits: DataFrame, most: int) -> DataFrame:
    """boundary, kind (lost, gained), split: between neighbouring regions, the smallest ``most`` of each kind."""
    w = Window.orderBy("start")
    pairs = ordered.select(F.col("end").alias("boundary"), F.col("tree_id").alias("before"), F.lead("tree_id").over(w).alias("after")).filter("after IS NOT NULL AND after <> before")
    s = splits.select("tree_id", "split", "size")

    def gone(x: str, y: str, kind: str) -> DataFrame:
        have = pairs.join(s.withColumnRenamed("tree_id", x), x)
        return have.join(s.select(F.col("tree_id").alias(y), "split"), [y, "split"], "left_anti").select("boundary", F.lit(kind).alias("kind"), "split", "size")

    both = gone("before", "after", "lost").unionByName(gone("after", "before", "gained"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("boundary", "kind").orderBy("size", "split"))).filter(F.col("rank") <= most)
