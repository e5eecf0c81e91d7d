"""Alignments in long form (taxon, site, base): filters, counts, distances and codon views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def informative_state(a: Column, b: Column, c: Column) -> Column:
    """Which pair of three bases is equal (0: a=b, 1: a=c, 2: b=c) if exactly two are, else -1."""
    known = a.isNotNull() & b.isNotNull() & c.isNotNull()
    state = F.when((a == b) & (b != c), 0).when((a == c) & (b != c), 1).when((b == c) & (a != b), 2).otherwise(-1)
    return F.when(known, state).otherwise(-1)


def site_masks(aln: DataFrame) -> DataFrame:
    """site, seen (bits of the bases seen), taxa (with a base)."""
    return aln.groupBy("site").agg(F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("base"))), F.lit(0)).alias("seen"), F.count("base").alias("taxa"))


def variable_sites(aln: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Sites with at least two different bases, in a range of sites."""
    if start is not None:
        aln = aln.filter(F.col("site") >= start)
    if end is not None:
        aln = aln.filter(F.col("site") <= end)
    return site_masks(aln).filter(F.bit_count("seen") > 1).select("site", "seen", "taxa")


def informative_mask_sites(masks: DataFrame) -> DataFrame:
    """Sites (taxon, site, mask) at which no base suits every taxon that has data."""
    some = masks.filter("mask <> 0")
    return some.groupBy("site").agg(F.bit_and("mask").alias("shared"), F.count(F.lit(1)).alias("taxa")).filter("shared = 0 AND taxa >= 2")


def bit_planes(aln: DataFrame, word: int = 32) -> DataFrame:
    """taxon, base, word, bits: sites of each base, ``word`` to an integer."""
    at = F.expr(f"(site - 1) div {word}").cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), ((F.col("site") - 1) % word).cast("int"))
    return aln.filter("base IS NOT NULL").groupBy("taxon", "base", at.alias("word")).agg(F.bit_or(bit).alias("bits"))


def drop_gap_columns(aln: DataFrame) -> DataFrame:
    """Without the sites that no taxon has; the rest renumbered from 1."""
    kept = aln.groupBy("site").agg(F.count("base").alias("n")).filter("n > 0")
    # numbers by running counts of site blocks, so no single task sees all sites
    block = kept.withColumn("block", F.expr("site div 4096"))
    ahead = block.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = block.join(F.broadcast(ahead.select("block", "ahead")), "block").withColumn("new_site", (F.col("ahead") + F.row_number().over(Window.partitionBy("block").orderBy("site"))).cast("int"))
    return aln.join(numbered.select("site", "new_site"), "site").select("taxon", F.col("new_site").alias("site"), "base")


def patterns(aln: DataFrame, taxa: int) -> tuple[DataFrame, DataFrame]:
    """(site, pattern) and (pattern, weight): identical columns are one pattern, written as its bases in order."""
    letters = F.array_sort(F.collect_list(F.struct("taxon", F.coalesce("base", F.lit(4)).alias("b"))))
    by_site = aln.groupBy("site").agg(letters.alias("l"))
    full = F.map_from_entries(F.transform("l", lambda x: F.struct(x["taxon"], x["b"])))
    pattern = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(taxa - 1)), lambda t: F.coalesce(F.try_element_at(full, t), F.lit(4)).cast("string")), "")
    by_site = by_site.select("site", pattern.alias("pattern"))
    return by_site, by_site.groupBy("pattern").agg(F.count(F.lit(1)).alias("weight"))


def pair_counts(aln: DataFrame) -> DataFrame:
    """a, b, compared, mismatches of each pair of taxa. The alignment is folded to one row for each site, so pairs arise within a row."""
    held = aln.filter("base IS NOT NULL").groupBy("site").agg(F.array_sort(F.collect_list(F.struct("taxon", "base"))).alias("t"))
    pairs = held.select(F.posexplode("t").alias("i", "x"), "t").select("x", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("y"))
    return pairs.groupBy(F.col("x.taxon").alias("a"), F.col("y.taxon").alias("b")).agg(
        F.count(F.lit(1)).alias("compared"), F.sum((F.col("x.base") != F.col("y.base")).cast("long")).alias("mismatches")
    )


def pair_distances(aln: DataFrame) -> DataFrame:
    return with_distance(pair_counts(aln))


def with_distance(counts: DataFrame) -> DataFrame:
    return counts.withColumn("distance", scalars.jukes_cantor(F.col("mismatches"), F.col("compared")))


def pattern_pair_counts(weighted: DataFrame, *keys: str) -> DataFrame:
    """keys, a, b, compared, mismatches of each pair of taxa, as pair_counts has them, from patterns with their weights."""
    letters = F.filter(F.transform(F.split("pattern", ""), lambda x, i: F.struct(i.alias("taxon"), x.alias("base"))), lambda x: x["base"].isin(*"0123"))
    held = weighted.select(*keys, "weight", letters.alias("t"))
    pairs = held.select(*keys, "weight", F.posexplode("t").alias("i", "x"), "t").select(*keys, "weight", "x", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("y"))
    return pairs.groupBy(*keys, F.col("x.taxon").alias("a"), F.col("y.taxon").alias("b")).agg(
        F.sum("weight").alias("compared"), F.sum(F.when(F.col("x.base") != F.col("y.base"), F.col("weight")).otherwise(0)).alias("mismatches")
    )


def base_frequencies(aln: DataFrame) -> DataFrame:
    n = aln.filter("base IS NOT NULL").groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy()))


def f3x4(codons: DataFrame) -> DataFrame:
    """position, base letter, frequency; codons with gaps stay in the denominator."""
    cells = codons.select(F.posexplode(F.split("codon", "")).alias("p", "letter")).filter("letter <> ''")
    counted = cells.groupBy((F.col("p") + 1).alias("position"), "letter").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("position")
    return counted.withColumn("frequency", F.col("n") / F.sum("n").over(total)).filter(F.col("letter").isin(*"ACGT"))


def codon_equilibrium(f3: DataFrame, codes: DataFrame) -> DataFrame:
    """table_id, codon, pi over sense codons, from position frequencies."""
    sense = codes.filter(~F.col("is_stop")).select("table_id", "codon", F.posexplode(F.split("codon", "")).alias("p", "letter")).filter("letter <> ''").withColumn("position", F.col("p") + 1)
    joined = sense.join(F.broadcast(f3), ["position", "letter"]).groupBy("table_id", "codon").agg(F.product("frequency").alias("product"))
    return joined.withColumn("pi", F.col("product") / F.sum("product").over(Window.partitionBy("table_id"))).select("table_id", "codon", "pi")


def exchangeabilities(aln: DataFrame) -> DataFrame:
    """base_a, base_b, rate: how often two bases share a site, over their frequencies, with geometric mean 1."""
    n = aln.filter("base IS NOT NULL").groupBy("site").pivot("base", [0, 1, 2, 3]).agg(F.count(F.lit(1)))
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    zero = lambda k: F.coalesce(F.col(str(k)), F.lit(0))
    sums = n.agg(*[F.sum(zero(i) * zero(j)).alias(f"s{i}{j}") for i, j in pairs], *[F.sum(zero(k)).alias(f"n{k}") for k in range(4)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("base_a"), F.lit(j).alias("base_b"), (F.col(f"s{i}{j}") + 0.5).alias("both"), (F.col(f"n{i}") * F.col(f"n{j}")).cast("double").alias("by_chance")) for i, j in pairs]))
    raw = sums.select(rows.alias("r")).select("r.base_a", "r.base_b", (F.col("r.both") / F.greatest(F.col("r.by_chance"), F.lit(1.0))).alias("raw"))
    return raw.withColumn("rate", F.col("raw") / F.exp(F.avg(F.ln("raw")).over(Window.partitionBy()))).select("base_a", "base_b", "rate")


def amino_acid_profile(codons: DataFrame, table: int = 1) -> DataFrame:
    """codon_site, aa, n, valid, missing, frequency, consensus; stops and broken codons count as missing."""
    from ..functions.codes import translate

    aa = F.nullif(translate(F.col("codon"), table), F.lit("*"))
    counted = codons.withColumn("aa", aa).groupBy("codon_site", "aa").agg(F.count(F.lit(1)).alias("n"))
    site = Window.partitionBy("codon_site")
    counted = counted.withColumn("missing", F.sum(F.when(F.col("aa").isNull(), F.col("n")).otherwise(0)).over(site))
    counted = counted.withColumn("valid", F.sum(F.when(F.col("aa").isNotNull(), F.col("n")).otherwise(0)).over(site)).filter("aa IS NOT NULL")
    first = F.row_number().over(site.orderBy(F.desc("n"), "aa")) == 1
    return counted.withColumn("frequency", F.col("n") / F.col("valid")).withColumn("consensus", first)


def diversity(aln: DataFrame) -> DataFrame:
    """One row: mean and quantiles of p-distance, variable and parsimony-informative fractions."""
    p = pair_counts(aln).withColumn("p", F.col("mismatches") / F.col("compared"))
    spread = p.agg(F.avg("p").alias("mean_p"), F.expr("percentile(p, 0.25)").alias("q25"), F.expr("percentile(p, 0.5)").alias("q50"), F.expr("percentile(p, 0.75)").alias("q75"))
    per_base = aln.filter("base IS NOT NULL").groupBy("site", "base").agg(F.count(F.lit(1)).alias("n"))
    per_site = per_base.groupBy("site").agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") >= 2).cast("int")).alias("shared"))
    sites = per_site.agg(F.count(F.lit(1)).alias("sites"), F.avg((F.col("kinds") > 1).cast("double")).alias("variable"), F.avg((F.col("shared") > 1).cast("double")).alias("informative"))
    return spread.crossJoin(sites)


def triplet_events(aln: DataFrame) -> DataFrame:
    """a, b, c, site, state, event (number in site order) of every informative site of every triplet."""
    held = aln.filter("base IS NOT NULL").groupBy("site").agg(F.array_sort(F.collect_list(F.struct("taxon", "base"))).alias("t"))
    # triplets arise within a row of one site; taxa of one alignment bound their number
    one = held.select("site", F.posexplode("t").alias("i", "x"), "t").select("site", "x", F.expr("slice(t, i + 2, size(t))").alias("t"))
    two = one.select("site", "x", F.posexplode("t").alias("j", "y"), "t").select("site", "x", "y", F.explode(F.expr("slice(t, j + 2, size(t))")).alias("z"))
    state = informative_state(F.col("x.base"), F.col("y.base"), F.col("z.base"))
    found = two.select(F.col("x.taxon").alias("a"), F.col("y.taxon").alias("b"), F.col("z.taxon").alias("c"), "site", state.alias("state")).filter("state >= 0")
    return found.withColumn("event", F.row_number().over(Window.partitionBy("a", "b", "c").orderBy("site")))


def slice_codons(sequences: DataFrame, start: int, end: int) -> DataFrame:
    return sequences.withColumn("sequence", F.substring("sequence", 3 * (start - 1) + 1, 3 * (end - start + 1)))


def slice_ranges(sequences: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Nucleotide ranges, inclusive and 1-based, one after the other."""
    return sequences.withColumn("sequence", F.concat(*[F.substring("sequence", a, b - a + 1) for a, b in ranges]))


def wrap_fasta(sequences: DataFrame, width: int = 80) -> DataFrame:
    """name, record: FASTA text of each sequence."""
    body = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    return sequences.select("name", F.concat(F.lit(">"), "name", F.lit("\n"), body, F.lit("\n")).alias("record"))


def join_tips(tips: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, tips without a sequence) by name."""
    return tips.join(sequences, "name"), tips.join(sequences, "name", "left_anti")
