"""Formats, data source and streams."""

import pytest
from pyspark.sql import functions as F

from treeline.functions import codes, scalars
from treeline.sources import files, parsers
from treeline.streaming import jobs


def test_fasta_grammar():
    text = "﻿; note\n>a first one\nac gu\nAC\n\n>b\nacgtac\n"
    assert list(parsers.fasta_records(text)) == [("a", "first one", "ACGUAC"), ("b", "", "ACGTAC")]
    assert parsers.checked_alignment(text, codons=True) == [("a", "ACGTAC"), ("b", "ACGTAC")]
    for bad in (">a\nAC\n>a\nAC", ">a\nAC\n>b\nA", ">a\nACG", "AC", ">\nAC"):
        with pytest.raises(ValueError):
            parsers.checked_alignment(bad)


def test_newick_round_trip_and_nexus():
    text = "((a{G1}:0.1,'b c''d':0.2)x:0.3,e:1);"
    tree = parsers.parse_newick(text)
    assert parsers.write_newick(tree) == text
    assert [n[2] for n in parsers.nodes_of(tree)] == ["", "x", "a", "b c'd", "e"]
    nexus = "#NEXUS\nbegin trees;\n tree one = [&R] (a:1,[note]b:2);\nend;"
    assert parsers.write_newick(parsers.parse_newick(nexus)) == "(a:1,b:2);"
    with pytest.raises(ValueError):
        parsers.parse_newick("((a,b);")


def test_structures():
    pdb = "ATOM      1  N   ALA A   1      0.0   0.0   0.0\nATOM      2  CA  ALA A   1      0.0\nHETATM    3  N   MSE B  -2A     0.0\nENDMDL\nATOM      4  N   GLY A   9"
    assert [r[:3] + r[4:] for r in parsers.pdb_residues(pdb)] == [("A", 1, "", "A"), ("B", -2, "A", "M")]
    cif = "data_x\nloop_\n_atom_site.group_PDB\n_atom_site.auth_asym_id\n_atom_site.auth_seq_id\n_atom_site.auth_comp_id\nATOM A 1 GLY\nATOM 'B' 2 TRP\n#\n"
    assert [(r[0], r[1], r[4]) for r in parsers.cif_residues(cif)] == [("A", 1, "G"), ("B", 2, "W")]


def test_fasta_source(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a\nACGT\n>b\nAC\n")
    (tmp_path / "y.nwk").write_text("(a,b);")
    parsers.register_fasta(spark)
    rows = spark.read.format("fasta").load(str(tmp_path / "x.fasta")).orderBy("ordinal").collect()
    assert [(r.name, r.sequence) for r in rows] == [("a", "ACGT"), ("b", "AC")]
    found = files.discover(spark, str(tmp_path)).collect()
    assert [r.kind for r in found] == ["alignment", "tree"]
    nodes = parsers.read_newick(parsers.text_files(spark, str(tmp_path / "y.nwk")))
    assert nodes.filter("tip_index IS NOT NULL").count() == 2
    assert parsers.read_fasta(parsers.text_files(spark, str(tmp_path / "x.fasta"))).count() == 2


def test_genetic_codes():
    assert len(codes.DIFFERENCES) == 24
    assert len(codes.sense_codons(1)) == 61 and len(codes.sense_codons(2)) == 60
    for t in codes.CONTEXT_DEPENDENT:
        with pytest.raises(ValueError):
            codes.genetic_code(t)


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.camel_label(F.lit("meanAlpha")).alias("label"), scalars.bayes_factor(F.lit(1.0), F.lit(0.5)).alias("bf"),
        scalars.exp_ratio(F.lit(800.0)).alias("big"), scalars.minimum_span(F.lit(10), F.lit(30.0), F.lit(0.0), F.lit(400)).alias("span"),
        scalars.log_add(F.lit(float("-inf")), F.lit(1.0)).alias("la"),
    ).first()
    assert (row.label, row.bf, row.big, row.span, row.la) == ("Mean Alpha", float("inf"), float("inf"), 60, 1.0)


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = jobs.read_events(spark, str(tmp_path / "in"))
    for name, df, mode in (("progress", jobs.windowed_progress(stream), "complete"), ("states", jobs.latest_states(stream), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("progress").agg(F.sum("n")).first()[0] == events.count()
    last = {r.user_id: r.event_id for r in jobs.latest_states(events).collect()}
    seen = {}
    for r in spark.table("states").collect():
        seen[r.user_id] = r.event_id
    assert set(seen) == set(last)
