"""Queries that need kernels: whole analyses of simulated or derived alignments. SQL can't express them; tests do."""

from __future__ import annotations

from ..operators import analyses as X
from .helpers import F, query, relation, rounded


def _four(spark, sf):
    """The derived alignment as one dataset."""
    return relation(spark, sf, "sequences").select(F.lit("aln").alias("dataset"), "name", "sequence")


def _simulated(spark, replicates=2, **options):
    return X.simulate_datasets(spark, replicates, **{"seed": 11, "taxa": 6, "codons": 40, **options})


@query("nj_tree")
def nj(spark, sf):
    return X.join_trees(_four(spark, sf))


@query("nj_seed_trees")
def seeds(spark, sf):
    return X.seed_trees(_four(spark, sf))


@query("simulated_truth")
def truth(spark, sf):
    return rounded(_simulated(spark, 4)[2])


@query("simulated_regions")
def regions(spark, sf):
    return _simulated(spark, 4, events=2)[3]


@query("analysis_site_selection")
def site_selection(spark, sf):
    sequences, trees, _, _ = _simulated(spark)
    return rounded(X.site_selection(sequences, trees))


@query("analysis_conditional_grid")
def conditional_grid(spark, sf):
    """8 taxa, 48 codons and a 36 x 36 grid."""
    from ..operators.grids import LOW, axis

    sequences, trees, _, _ = _simulated(spark, 1, taxa=8, codons=48)
    a, b = axis(spark, 36, "alpha", LOW, 2.0 / 35), axis(spark, 36, "beta", LOW, 2.0 / 35)
    grid = a.crossJoin(F.broadcast(b)).select((F.col("alpha_idx") * 36 + F.col("beta_idx")).alias("category"), "alpha", "beta")
    return rounded(X.conditional_grid(sequences, trees, grid))


@query("analysis_two_group")
def two_group(spark, sf):
    sequences, trees, _, _ = _simulated(spark)
    tagged = trees.withColumn("newick", F.regexp_replace(F.regexp_replace("newick", r"(?<=[(,])(t[01]):", "$1{G1}:"), r"(?<=[(,])(t[23]):", "$1{G2}:"))
    return rounded(X.two_group_selection(sequences, tagged))


@query("analysis_episodic")
def episodic(spark, sf):
    sequences, trees, _, _ = _simulated(spark)
    return rounded(X.episodic_selection(sequences, trees))


@query("analysis_gamma_ratio")
def gamma_ratio(spark, sf):
    sequences, trees, _, _ = _simulated(spark)
    return rounded(X.gamma_selection(sequences, trees))


@query("analysis_branch_tests")
def branch_tests(spark, sf):
    sequences, trees, _, _ = _simulated(spark)
    return rounded(X.branch_selection(sequences, trees), 4)


@query("analysis_branch_site_scan")
def branch_sites(spark, sf):
    sequences, trees, _, _ = _simulated(spark)
    return rounded(X.branch_site_scan(sequences, trees))


@query("analysis_clade_shift")
def clade_shift(spark, sf):
    from ..operators.mixtures import burden

    sequences, trees, _, _ = _simulated(spark)
    scan = X.clade_shift_scan(sequences, trees)
    rows = scan.filter("node_id > 0").select((F.hash("dataset").cast("long") * 1000 + F.col("site")).alias("site"), F.col("node_id").alias("branch"), "k", "logl", F.lit(0.05).alias("prior"))
    return rounded(burden(rows))


@query("recombination_tree_segments")
def tree_segments(spark, sf):
    sequences, _, _, _ = _simulated(spark, 2, events=1, codons=80)
    profiles = X.tree_profiles(sequences, X.seed_trees(sequences))
    return X.tree_segments(profiles.select("dataset", "site", F.col("seed").alias("state"), "logl"))


def _refined(spark, sf):
    """(refined signals of all triplets of the derived alignment, its sites)."""
    from ..operators.signals import refine_alignment

    aln = relation(spark, sf, "aln")
    sites = aln.agg(F.max("site")).first()[0] or 0
    return refine_alignment(aln, sites, 10), sites


@query("recombination_signals")
def refined_signals(spark, sf):
    return rounded(_refined(spark, sf)[0])


@query("recombination_consensus")
def consensus(spark, sf):
    from ..operators.signals import merged

    return rounded(merged(*_refined(spark, sf)))


@query("recombination_cuts")
def cuts(spark, sf):
    from ..operators.signals import cuts, merged

    signals, sites = _refined(spark, sf)
    return rounded(cuts(merged(signals, sites).withColumn("dataset", F.lit("aln")), sites))


@query("recombination_retained_states")
def retained_states(spark, sf):
    profiles = relation(spark, sf, "emission").select(F.lit("aln").alias("dataset"), "site", F.col("tree_id").alias("state"), "logl")
    return X.low_switch_segments(profiles)


@query("recombination_spr_path")
def spr_path(spark, sf):
    sequences, _, _, _ = _simulated(spark, 2, events=1, codons=80)
    return X.spr_reconstruction(sequences)


@query("profile_alignment")
def profile_alignment(spark, sf):
    from ..operators.alignment import amino_acid_profile

    profile = amino_acid_profile(relation(spark, sf, "codons")).select(F.lit("aln").alias("profile"), "codon_site", "aa", "frequency")
    chains = relation(spark, sf, "codons")
    from ..functions.codes import translate

    letters = F.transform(F.array_sort(F.collect_list(F.struct("codon_site", F.coalesce(F.nullif(translate(F.col("codon")), F.lit("*")), F.lit("X")).alias("a")))), lambda x: x["a"])
    residues = chains.groupBy(F.col("taxon").cast("string").alias("chain")).agg(F.array_join(letters, "").alias("residues"))
    return rounded(X.align_profiles(profile, residues))


@query("recombination_joint_network")
def joint_network(spark, sf):
    sequences, _, _, _ = _simulated(spark, 3, events=1, codons=80, taxa=5, scale=0.6)
    return X.joint_network(sequences, 3.0, 2.0, 1)


@query("recombination_stepwise")
def stepwise(spark, sf):
    sequences, _, _, _ = _simulated(spark, 2, events=1, codons=80)
    return X.stepwise_regions(sequences)
