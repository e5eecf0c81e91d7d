"""Queries and analyses take their whole input."""

from treeline.operators import analyses as X
from treeline.operators import grids as G
from treeline.operators import signals as Z
from treeline.plans import registry
from treeline.relations import TAXA, relation

QUERIES = registry.queries()


def test_profile_alignment_takes_all_taxa_and_sites(spark, sf_dir, monkeypatch):
    seen = {}

    def spy(profile, residues, call=X.align_profiles):
        seen["sites"] = {r.codon_site for r in profile.collect()}
        seen["residues"] = {r.chain: len(r.residues) for r in residues.collect()}
        return call(profile, residues)

    monkeypatch.setattr(X, "align_profiles", spy)
    found = {r.chain: r for r in QUERIES["profile_alignment"](spark, sf_dir).collect()}
    assert set(found) == {str(t) for t in range(TAXA)} and all(r.pairs > 0 for r in found.values())
    sites = relation(spark, sf_dir, "cells").selectExpr("max(site)").first()[0]
    assert seen["residues"] == {str(t): sites // 3 for t in range(TAXA)} and max(seen["sites"]) == sites // 3 and len(seen["sites"]) > 30


def test_relations_grow_with_the_tables(spark):
    for name in ("aln", "cells", "codons", "lik", "emission", "region_runs", "signal", "truth", "events_chain"):
        small, large = (relation(spark, f"/root/testdata/sf{sf}", name).count() for sf in ("0.001", "0.01"))
        assert large >= 4 * small, name


def signals_of(spark, scores):
    rows = [(k, 100, 101, site, site, float(e), 1.0, site - 1, site + 1) for k, (site, e) in enumerate(scores)]
    return spark.createDataFrame(rows, "a int, b int, c int, event int, breakpoint int, evidence double, switch double, interval_low int, interval_high int")


def test_consensus_is_the_heaviest_separated_set(spark):
    # more than 10 separated centres all stay, strongest first
    found = Z.merged(signals_of(spark, [(100 * k, 5 + k / 10) for k in range(1, 31)]), 3100).collect()
    assert sorted(r.breakpoint for r in found) == [100 * k for k in range(1, 31)] and sorted(r["rank"] for r in found) == list(range(1, 31))
    assert min(found, key=lambda r: r["rank"]).breakpoint == 3000
    # a strong centre between two that are heavier together; the limit; the penalty; the ends
    near = signals_of(spark, [(100, 6), (110, 8), (120, 6)])
    taken = lambda sites=1000, **options: sorted(r.breakpoint for r in Z.merged(near, sites, bandwidth=1, **options).collect())
    assert taken() == [100, 120] and taken(130) == [110] and taken(114) == []
    assert taken(most=1) == [110] and taken(penalty=2.8) == [110] and taken(penalty=11.0) == []


def test_site_grids_are_whole_and_arguments(spark):
    rates, highs = G.site_rates(), G.transformed_rates(0.01, 10, 4)
    assert len(rates) == 20 and abs(rates[0] - 0.00235) < 1e-5 and abs(rates[-1] - 34.472) < 1e-3
    assert len(highs) == 8 and abs(highs[4] - 1) < 1e-12 and len(G.transformed_rates(0.01, 13, 6)) == 12
    sequences, trees, _, _ = X.simulate_datasets(spark, 1, seed=11, taxa=5, codons=12)
    whole = X.site_selection(sequences, trees).toPandas()
    assert len(whole) == 12 and whole[["mean_alpha", "mean_beta"]].to_numpy().max() > 5  # the largest rate was 5
    cut = X.site_selection(sequences, trees, rates=[1.0, 1.5, 2.0]).toPandas()
    assert cut[["mean_alpha", "mean_beta"]].to_numpy().min() >= 1 and cut[["mean_alpha", "mean_beta"]].to_numpy().max() <= 2
    found = X.episodic_selection(sequences, trees, alphas=[3.0], lows=[0.2], highs=[0.5, 4.0]).toPandas()
    assert abs(found["mean_alpha"] - 3).max() < 1e-9 and abs(found["mean_low"] - 0.6).max() < 1e-9
