"""Genetic codes, IUPAC masks and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The standard genetic code in the usual T, C, A, G order of codons.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: How the other public translation tables differ from the standard one.
DIFFERENCES = {
    1: "", 2: "AGA* AGG* ATAM TGAW", 3: "ATAM CTTT CTCT CTAT CTGT TGAW", 4: "TGAW", 5: "AGAS AGGS ATAM TGAW", 6: "TAAQ TAGQ",
    9: "AAAN AGAS AGGS TGAW", 10: "TGAC", 11: "", 12: "CTGS", 13: "AGAG AGGG ATAM TGAW", 14: "AAAN AGAS AGGS TAAY TGAW", 15: "TAGQ",
    16: "TAGL", 21: "AAAN AGAS AGGS ATAM TGAW", 22: "TCA* TAGL", 23: "TTA*", 24: "AGAS AGGK TGAW", 25: "TGAG", 26: "CTGA", 29: "TAAY TAGY",
    30: "TAAE TAGE", 32: "TAGW", 33: "TAAY TGAW AGAS AGGK",
}
#: Tables whose stop codons depend on their context can't be used.
CONTEXT_DEPENDENT = (27, 28, 31)
#: Bases of each IUPAC letter as bits A=1, C=2, G=4, T=8.
IUPAC = {
    "A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12, "V": 7, "H": 11, "D": 13, "B": 14, "N": 15,
}


def genetic_code(table: int = 1) -> dict[str, str]:
    """codon -> amino acid letter, '*' for stop."""
    if table in CONTEXT_DEPENDENT:
        raise ValueError(f"genetic code {table} depends on context")
    if table not in DIFFERENCES:
        raise ValueError(f"there is no genetic code {table}")
    codons = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
    code = dict(zip(codons, STANDARD, strict=True))
    for change in DIFFERENCES[table].split():
        code[change[:3]] = change[3]
    return code


def sense_codons(table: int = 1) -> list[str]:
    """Sense codons in alphabetical order; their places are the states of codon models."""
    return sorted(c for c, aa in genetic_code(table).items() if aa != "*")


def code_table(spark: SparkSession, tables: tuple[int, ...] = tuple(DIFFERENCES)) -> DataFrame:
    """table_id, codon, aa, is_stop, state (null for stops)."""
    rows = []
    for t in tables:
        states = {c: k for k, c in enumerate(sense_codons(t))}
        rows += [(t, c, aa, aa == "*", states.get(c)) for c, aa in sorted(genetic_code(t).items())]
    return spark.createDataFrame(rows, "table_id int, codon string, aa string, is_stop boolean, state int")


def translate(codon: Column, table: int = 1) -> Column:
    """Amino acid of a codon (U read as T); null for anything that is no codon."""
    code = F.create_map(*[F.lit(x) for pair in genetic_code(table).items() for x in pair])
    return F.element_at(code, F.translate(F.upper(codon), "U", "T"))


def codon_neighbors(codes: DataFrame) -> DataFrame:
    """Pairs of sense codons one nucleotide apart: from_codon, to_codon, position, from_nt, to_nt, synonymous."""
    sense = codes.filter(~F.col("is_stop"))
    a, b = sense.alias("a"), sense.alias("b")
    differs = [(F.substring("a.codon", k, 1) != F.substring("b.codon", k, 1)).cast("int") for k in (1, 2, 3)]
    pairs = a.join(F.broadcast(b), (F.col("a.table_id") == F.col("b.table_id")) & (differs[0] + differs[1] + differs[2] == 1))
    position = F.when(differs[0] == 1, 1).when(differs[1] == 1, 2).otherwise(3)
    pairs = pairs.select(F.col("a.table_id").alias("table_id"), F.col("a.codon").alias("from_codon"), F.col("b.codon").alias("to_codon"), position.alias("position"), (F.col("a.aa") == F.col("b.aa")).alias("synonymous"))
    return pairs.withColumn("from_nt", F.substring(F.col("from_codon"), F.col("position"), F.lit(1))).withColumn("to_nt", F.substring(F.col("to_codon"), F.col("position"), F.lit(1)))


def iupac_mask(letter: Column) -> Column:
    """Bases that a letter stands for as bits; 0 for gaps and anything else."""
    masks = F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair])
    return F.coalesce(F.element_at(masks, F.upper(letter)), F.lit(0))


def alphabet(sequence: Column) -> Column:
    """nucleotide, amino-acid or mixed."""
    s = F.upper(sequence)
    return F.when(s.rlike(r"^[ACGTUNRYSWKMBDHV?.\-]*$"), "nucleotide").when(s.rlike(r"^[ABCDEFGHIKLMNPQRSTVWXYZ*?.\-]*$"), "amino-acid").otherwise("mixed")
