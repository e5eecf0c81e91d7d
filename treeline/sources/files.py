"""Input files: discovery, kinds and pairs of alignment and tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of each kind of input.
ALIGNMENT = ("fasta", "fa", "fas", "fna", "aln")
TREE = ("nwk", "newick", "tree", "tre", "nex", "nexus")


def kind_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(extension.isin(*ALIGNMENT), "alignment").when(extension.isin(*TREE), "tree")


def stem_of(path: Column) -> Column:
    """Lower-case file name without its last extension; a leading dot is part of the name."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def discover(spark: SparkSession, *paths: str) -> DataFrame:
    """path, kind of every alignment and tree below the paths, each once, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path")
    return files.distinct().withColumn("kind", kind_of(F.col("path"))).filter("kind IS NOT NULL").orderBy("path")


def pair_by_stem(alignments: DataFrame, trees: DataFrame) -> DataFrame:
    """stem, status (matched, missing, ambiguous) and tree of each alignment's stem."""
    a = alignments.groupBy(stem_of(F.col("path")).alias("stem")).agg(F.count(F.lit(1)).alias("a"))
    t = trees.groupBy(stem_of(F.col("path")).alias("stem")).agg(F.count(F.lit(1)).alias("t"), F.min("path").alias("tree"))
    status = F.when(F.col("t").isNull(), "missing").when((F.col("t") > 1) | (F.col("a") > 1), "ambiguous").otherwise("matched")
    return a.join(t, "stem", "left").select("stem", status.alias("status"), F.when(status == "matched", F.col("tree")).alias("tree"))


def structure_format(name: Column, text: Column) -> Column:
    """pdb or mmcif, by extension and else by content."""
    return (
        F.when(F.lower(name).rlike(r"\.(cif|mmcif)$"), "mmcif").when(F.lower(name).rlike(r"\.(pdb|ent)$"), "pdb")
        .when(text.rlike(r"(?m)^(data_|_atom_site\.|loop_)"), "mmcif").when(text.rlike(r"(?m)^(ATOM  |HETATM|HEADER)"), "pdb")
    )
