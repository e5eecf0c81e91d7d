"""Queries over the derived alignment."""

from __future__ import annotations

from ..functions import codes, scalars
from ..operators import alignment as A
from ..relations import TAXA
from .helpers import F, oracle, query, relation, rounded


@query("aln_variable_sites", oracle("""SELECT site, bit_or(CASE WHEN base IS NULL THEN 0 ELSE (1 << base) END)::INT AS seen, COUNT(base) AS taxa
    FROM aln GROUP BY site HAVING COUNT(DISTINCT base) > 1"""))
def variable_sites(spark, sf):
    return A.variable_sites(relation(spark, sf, "aln"))


@query("aln_variable_count_range", oracle("""SELECT COUNT(*) AS variable FROM (SELECT site FROM aln WHERE site BETWEEN 31 AND 200 GROUP BY site HAVING COUNT(DISTINCT base) > 1)"""))
def variable_count(spark, sf):
    return A.variable_sites(relation(spark, sf, "aln"), 31, 200).agg(F.count(F.lit(1)).alias("variable"))


@query("aln_informative_masks", oracle("""SELECT site, bit_and(m) AS shared, COUNT(*) AS taxa FROM (
    SELECT site, (CASE WHEN base IS NULL THEN 0 WHEN (taxon + site) % 5 = 0 THEN (1 << base) | 1 ELSE (1 << base) END)::INT AS m FROM aln) WHERE m <> 0
    GROUP BY site HAVING bit_and(m) = 0 AND COUNT(*) >= 2"""))
def informative_masks(spark, sf):
    bit = F.call_function("shiftleft", F.lit(1), F.col("base"))
    masks = relation(spark, sf, "aln").select("taxon", "site", F.when(F.col("base").isNull(), 0).when((F.col("taxon") + F.col("site")) % 5 == 0, bit.bitwiseOR(1)).otherwise(bit).alias("mask"))
    return A.informative_mask_sites(masks)


@query("aln_bit_planes", oracle("""SELECT taxon, base, ((site - 1) // 32)::INT AS word, bit_or((1::BIGINT << ((site - 1) % 32)))::BIGINT AS bits
    FROM aln WHERE base IS NOT NULL GROUP BY ALL"""))
def bit_planes(spark, sf):
    return A.bit_planes(relation(spark, sf, "aln"))


@query("aln_gap_columns_removed", oracle("""WITH h AS (SELECT taxon, site, base FROM aln WHERE base > 1), k AS (SELECT site, (row_number() OVER (ORDER BY site))::INT AS new_site
    FROM (SELECT DISTINCT site FROM h)) SELECT taxon, new_site AS site, base FROM h JOIN k USING (site)"""))
def gap_columns(spark, sf):
    return A.drop_gap_columns(relation(spark, sf, "aln").filter("base > 1"))


@query("aln_patterns", oracle("""WITH p AS (SELECT site, string_agg(COALESCE(base, 4)::VARCHAR, '' ORDER BY taxon) AS pattern FROM cells GROUP BY site)
    SELECT pattern, COUNT(*) AS weight FROM p GROUP BY pattern"""))
def patterns(spark, sf):
    return A.patterns(relation(spark, sf, "aln"), TAXA)[1]


_JC = "CASE WHEN compared > 0 THEN -0.75 * ln(1 - 4 * least(mismatches::DOUBLE / compared, 0.74) / 3) ELSE 1.0 END"
_PAIRS = """p AS (SELECT x.taxon AS a, y.taxon AS b, COUNT(*) AS compared, SUM(CASE WHEN x.base <> y.base THEN 1 ELSE 0 END)::BIGINT AS mismatches
    FROM aln x JOIN aln y ON x.site = y.site AND x.taxon < y.taxon AND x.base IS NOT NULL AND y.base IS NOT NULL GROUP BY 1, 2)"""


@query("aln_pair_distances", oracle(f"WITH {_PAIRS} SELECT a, b, compared, mismatches, round({_JC}, 6) AS distance FROM p"))
def pair_distances(spark, sf):
    return rounded(A.pair_distances(relation(spark, sf, "aln")))


@query("aln_diversity", oracle(f"""WITH {_PAIRS}, q AS (SELECT mismatches::DOUBLE / compared AS p FROM p),
    s AS (SELECT site, COUNT(*) AS kinds, SUM(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS shared FROM (SELECT site, base, COUNT(*) AS n FROM aln WHERE base IS NOT NULL GROUP BY 1, 2) GROUP BY site)
    SELECT round(avg(p), 6) AS mean_p, round(quantile_cont(p, 0.25), 6) AS q25, round(quantile_cont(p, 0.5), 6) AS q50, round(quantile_cont(p, 0.75), 6) AS q75,
    (SELECT COUNT(*) FROM s) AS sites, (SELECT round(avg((kinds > 1)::INT), 6) FROM s) AS variable, (SELECT round(avg((shared > 1)::INT), 6) FROM s) AS informative FROM q"""))
def diversity(spark, sf):
    return rounded(A.diversity(relation(spark, sf, "aln")))


@query("aln_base_frequencies", oracle("""SELECT base, COUNT(*) AS n, round(COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (), 6) AS frequency FROM aln WHERE base IS NOT NULL GROUP BY base"""))
def base_frequencies(spark, sf):
    return rounded(A.base_frequencies(relation(spark, sf, "aln")))


_F3 = """f AS (SELECT ((site - 1) % 3 + 1)::INT AS position, letter, COUNT(*) AS n, COUNT(*)::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY (site - 1) % 3) AS frequency FROM cells GROUP BY 1, 2, (site - 1) % 3)"""


@query("codon_f3x4", oracle(f"WITH {_F3} SELECT position, letter, n, round(frequency, 6) AS frequency FROM f WHERE letter <> '-'"))
def f3x4(spark, sf):
    return rounded(A.f3x4(relation(spark, sf, "codons")))


def _code_values(table: int) -> str:
    return ", ".join(f"('{c}', '{a}')" for c, a in sorted(codes.genetic_code(table).items()))


@query("codon_equilibrium", oracle(f"""WITH {_F3}, c(codon, aa) AS (VALUES {_code_values(1)}),
    p AS (SELECT codon, x.frequency * y.frequency * z.frequency AS v FROM c JOIN f x ON x.position = 1 AND x.letter = substr(codon, 1, 1)
      JOIN f y ON y.position = 2 AND y.letter = substr(codon, 2, 1) JOIN f z ON z.position = 3 AND z.letter = substr(codon, 3, 1) WHERE aa <> '*')
    SELECT 1 AS table_id, codon, round(v / SUM(v) OVER (), 6) AS pi FROM p"""))
def codon_equilibrium(spark, sf):
    return rounded(A.codon_equilibrium(A.f3x4(relation(spark, sf, "codons")), codes.code_table(spark, (1,))))


@query("aln_exchangeabilities", oracle("""WITH n AS (SELECT site, b.base, COUNT(a.base) AS n FROM (SELECT unnest(range(4))::INT AS base) b CROSS JOIN (SELECT DISTINCT site FROM aln) s
      LEFT JOIN aln a USING (site, base) GROUP BY 1, 2), t AS (SELECT base, SUM(n)::DOUBLE AS n FROM n GROUP BY 1),
    r AS (SELECT x.base AS base_a, y.base AS base_b, (SUM(x.n * y.n) + 0.5) / any_value(tx.n * ty.n) AS raw FROM n x JOIN n y ON x.site = y.site AND x.base < y.base
      JOIN t tx ON tx.base = x.base JOIN t ty ON ty.base = y.base GROUP BY 1, 2)
    SELECT base_a, base_b, round(raw / exp(avg(ln(raw)) OVER ()), 6) AS rate FROM r"""))
def exchangeabilities(spark, sf):
    return rounded(A.exchangeabilities(relation(spark, sf, "aln")))


@query("codon_amino_acid_profile", oracle(f"""WITH c(codon, aa) AS (VALUES {_code_values(1)}), k AS (SELECT codon_site, nullif(aa, '*') AS aa, COUNT(*) AS n FROM codons LEFT JOIN c USING (codon) GROUP BY 1, 2),
    w AS (SELECT *, COALESCE(SUM(n) FILTER (aa IS NULL) OVER s, 0)::BIGINT AS missing, COALESCE(SUM(n) FILTER (aa IS NOT NULL) OVER s, 0)::BIGINT AS valid FROM k WINDOW s AS (PARTITION BY codon_site))
    SELECT codon_site, aa, n, missing, valid, round(n::DOUBLE / valid, 6) AS frequency, row_number() OVER (PARTITION BY codon_site ORDER BY n DESC, aa) = 1 AS consensus FROM w WHERE aa IS NOT NULL"""))
def aa_profile(spark, sf):
    return rounded(A.amino_acid_profile(relation(spark, sf, "codons")))


@query("codon_translate", oracle(f"WITH c(codon, aa) AS (VALUES {_code_values(2)}) SELECT taxon, codon_site, codon, aa FROM codons LEFT JOIN c USING (codon)"))
def translate(spark, sf):
    return relation(spark, sf, "codons").select("taxon", "codon_site", "codon", codes.translate(F.col("codon"), 2).alias("aa"))


@query("codon_neighbors", f"""WITH c(codon, aa) AS (VALUES {_code_values(1)}), p AS (SELECT x.codon AS from_codon, y.codon AS to_codon, x.aa = y.aa AS synonymous,
      CASE WHEN substr(x.codon, 1, 1) <> substr(y.codon, 1, 1) THEN 1 WHEN substr(x.codon, 2, 1) <> substr(y.codon, 2, 1) THEN 2 ELSE 3 END AS position
    FROM c x JOIN c y ON hamming(x.codon, y.codon) = 1 WHERE x.aa <> '*' AND y.aa <> '*')
    SELECT 1 AS table_id, *, substr(from_codon, position, 1) AS from_nt, substr(to_codon, position, 1) AS to_nt FROM p""")
def codon_neighbors(spark, sf):
    return codes.codon_neighbors(codes.code_table(spark, (1,)))


_EVENTS = """e AS (SELECT x.taxon AS a, y.taxon AS b, z.taxon AS c, x.site AS site, CASE WHEN x.base = y.base AND y.base <> z.base THEN 0 WHEN x.base = z.base AND y.base <> z.base THEN 1
      WHEN y.base = z.base AND x.base <> y.base THEN 2 ELSE -1 END AS state FROM aln x JOIN aln y ON x.site = y.site AND x.taxon < y.taxon JOIN aln z ON z.site = y.site AND y.taxon < z.taxon
      WHERE x.base IS NOT NULL AND y.base IS NOT NULL AND z.base IS NOT NULL),
    v AS (SELECT *, (row_number() OVER (PARTITION BY a, b, c ORDER BY site))::INT AS event FROM e WHERE state >= 0)"""


@query("triplet_events", oracle(f"WITH {_EVENTS} SELECT * FROM v"))
def triplet_events(spark, sf):
    return A.triplet_events(relation(spark, sf, "aln"))


@query("triplet_event_counts", oracle(f"WITH {_EVENTS} SELECT a, b, c, COUNT(*) AS events, COUNT(*) FILTER (state = 0) AS s0, COUNT(*) FILTER (state = 1) AS s1, COUNT(*) FILTER (state = 2) AS s2 FROM v GROUP BY a, b, c"))
def triplet_counts(spark, sf):
    return A.triplet_events(relation(spark, sf, "aln")).groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("events"), *[F.count_if(F.col("state") == s).alias(f"s{s}") for s in range(3)])


def _xlx(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ({x})::DOUBLE * ln(({x})::DOUBLE) ELSE 0.0 END)"


_G = "2 * (" + " + ".join(_xlx(f"{s}{k}") for s in "lr" for k in range(3)) + " - " + " - ".join(_xlx(f"(l{k} + r{k})") for k in range(3)) + f" - {_xlx('(l0 + l1 + l2)')} - {_xlx('(r0 + r1 + r2)')} + {_xlx('(l0 + l1 + l2 + r0 + r1 + r2)')})"
_COUNTS = ", ".join(f"COALESCE(SUM((state = {k})::INT) OVER {w}, 0)::BIGINT AS {s}{k}" for s, w in (("l", "lw"), ("r", "rw")) for k in range(3))


@query("triplet_rolling_scan", oracle(f"""WITH {_EVENTS}, n AS (SELECT *, {_COUNTS} FROM v WINDOW lw AS (PARTITION BY a, b, c ORDER BY event ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
      rw AS (PARTITION BY a, b, c ORDER BY event ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    g AS (SELECT *, CASE WHEN l0 + l1 + l2 = 5 AND r0 + r1 + r2 = 5 THEN round({_G}, 9) END AS g FROM n)
    SELECT a, b, c, site, event, round(g, 6) AS g FROM (SELECT *, COALESCE(g >= COALESCE(lag(g) OVER w, 0.0) AND g > COALESCE(lead(g) OVER w, 0.0), false) AS peak FROM g WINDOW w AS (PARTITION BY a, b, c ORDER BY event)) WHERE peak"""))
def rolling_scan(spark, sf):
    from ..operators.triplet_scan import event_blocks, peaks

    return rounded(peaks(event_blocks(relation(spark, sf, "aln")), 5))


@query("triplet_top_signals", oracle(f"""WITH {_EVENTS}, n AS (SELECT *, {_COUNTS} FROM v WINDOW lw AS (PARTITION BY a, b, c ORDER BY event ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
      rw AS (PARTITION BY a, b, c ORDER BY event ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
    SELECT a, b, c, site, round({_G}, 6) AS g FROM n WHERE l0 + l1 + l2 = 10 AND r0 + r1 + r2 = 10 ORDER BY round({_G}, 9) DESC, a, b, c, site LIMIT 20"""))
def top_signals(spark, sf):
    from ..operators.ranking import top_k
    from ..operators.triplet_scan import event_blocks, strongest

    found = strongest(event_blocks(relation(spark, sf, "aln")), 10, 20)
    return rounded(top_k(found, 20, F.desc("g"), F.col("a"), F.col("b"), F.col("c"), F.col("site")))


@query("triplet_dominant_state", oracle(f"""WITH {_EVENTS}, n AS (SELECT a, b, c, COUNT(*) FILTER (state = 0) AS s0, COUNT(*) FILTER (state = 1) AS s1, COUNT(*) FILTER (state = 2) AS s2 FROM v GROUP BY a, b, c)
    SELECT a, b, c, CASE WHEN s0 > s1 AND s0 > s2 THEN 0 WHEN s1 > s0 AND s1 > s2 THEN 1 WHEN s2 > s0 AND s2 > s1 THEN 2 ELSE -1 END AS state FROM n"""))
def dominant_state(spark, sf):
    from ..operators.windows import dominant

    n = triplet_counts(spark, sf)
    return n.select("a", "b", "c", dominant([F.col(f"s{s}") for s in range(3)]).alias("state"))


@query("sequence_slices", oracle("SELECT taxon, name, substr(sequence, 28, 60) AS sequence FROM sequences"))
def slices(spark, sf):
    return A.slice_codons(relation(spark, sf, "sequences"), 10, 29)


@query("sequence_ranges", oracle("SELECT taxon, name, substr(sequence, 1, 30) || substr(sequence, 101, 50) AS sequence FROM sequences"))
def ranges(spark, sf):
    return A.slice_ranges(relation(spark, sf, "sequences"), [(1, 30), (101, 150)])


@query("sequence_fasta_text", oracle("""SELECT name, '>' || name || chr(10) || regexp_replace(sequence, '(.{1,80})', '\\1' || chr(10), 'g') AS record FROM sequences"""))
def fasta_text(spark, sf):
    return A.wrap_fasta(relation(spark, sf, "sequences"))


@query("sequence_digest", oracle("SELECT name, sha256(sequence) AS digest FROM sequences"))
def digest(spark, sf):
    return relation(spark, sf, "sequences").select("name", F.sha2("sequence", 256).alias("digest"))


@query("sequence_alphabet", oracle(r"""SELECT p_partkey, CASE WHEN regexp_full_match(upper(p_brand), '[ACGTUNRYSWKMBDHV?.\-]*') THEN 'nucleotide' WHEN regexp_full_match(upper(p_brand), '[ABCDEFGHIKLMNPQRSTVWXYZ*?.\-]*') THEN 'amino-acid' ELSE 'mixed' END AS alphabet FROM part
    UNION ALL SELECT 1000000 + taxon, 'nucleotide' FROM sequences"""))
def alphabets(spark, sf):
    from .helpers import table

    parts = table(spark, sf, "part").select("p_partkey", codes.alphabet(F.col("p_brand")).alias("alphabet"))
    return parts.unionByName(relation(spark, sf, "sequences").select((F.lit(1000000).cast("long") + F.col("taxon")).alias("p_partkey"), codes.alphabet(F.col("sequence")).alias("alphabet")))


@query("tips_without_sequence", oracle("SELECT name FROM tree WHERE depth = 2 AND name NOT IN (SELECT n_name FROM nation WHERE n_nationkey % 3 <> 0)"))
def tips_without(spark, sf):
    from .helpers import table

    have = table(spark, sf, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("name"))
    return A.join_tips(relation(spark, sf, "tree").filter("depth = 2").select("name"), have)[1]


_EVERY_CODE = ", ".join(f"({t}, '{c}', '{a}')" for t in codes.DIFFERENCES for c, a in sorted(codes.genetic_code(t).items()))


@query("codon_equilibrium_all_codes", oracle(f"""WITH {_F3}, c(table_id, codon, aa) AS (VALUES {_EVERY_CODE}),
    p AS (SELECT table_id, codon, x.frequency * y.frequency * z.frequency AS v FROM c JOIN f x ON x.position = 1 AND x.letter = substr(codon, 1, 1)
      JOIN f y ON y.position = 2 AND y.letter = substr(codon, 2, 1) JOIN f z ON z.position = 3 AND z.letter = substr(codon, 3, 1) WHERE aa <> '*')
    SELECT table_id, codon, round(v / SUM(v) OVER (PARTITION BY table_id), 6) AS pi FROM p"""))
def equilibrium_all(spark, sf):
    return rounded(A.codon_equilibrium(A.f3x4(relation(spark, sf, "codons")), codes.code_table(spark)))


@query("taxa_initial_branch_length", oracle(f"WITH {_PAIRS} SELECT round(avg({_JC}) / 2, 6) AS length FROM p"))
def initial_length(spark, sf):
    return rounded(A.pair_distances(relation(spark, sf, "aln")).agg((F.avg("distance") / 2).alias("length")))


@query("aln_open_distance", oracle(f"WITH {_PAIRS} SELECT a, b, round(CASE WHEN mismatches * 4 >= compared * 3 THEN 99.0 ELSE -0.75 * ln(1 - 4 * (mismatches::DOUBLE / compared) / 3) END, 6) AS distance FROM p"))
def open_distance(spark, sf):
    d = scalars.jukes_cantor_open(F.col("mismatches"), F.col("compared"))
    return A.pair_counts(relation(spark, sf, "aln")).select("a", "b", F.round(F.least(d, F.lit(99.0)), 6).alias("distance"))
