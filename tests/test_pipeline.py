"""Definitions, routes, command line and reports."""

import json

import pytest

from treeline.__main__ import main
from treeline.plans import pipeline


def definition(**changes):
    nodes = [
        {"id": "m", "kind": "selection", "modelId": "selection", "parameters": {"threshold": 0.8}}, {"id": "nj", "kind": "nj-tree"},
        {"id": "mine", "kind": "user-tree"}, {"id": "sim", "kind": "simulator", "parameters": {"replicates": 1, "taxa": 4, "codons": 12}},
    ]
    return json.dumps({"schemaVersion": 1, "id": "x", "nodes": nodes} | changes)


def test_parse_orders_and_checks():
    assert [n.id for n in pipeline.parse(definition())] == ["sim", "nj", "mine", "m"]
    nodes = json.loads(definition())["nodes"]
    for bad in (
        {"schemaVersion": 2}, {"nodes": [*nodes, nodes[0]]}, {"nodes": [*nodes, {"id": "z", "kind": "what"}]}, {"nodes": [{**nodes[0], "modelId": "none"}, *nodes[1:]]},
        {"nodes": [{**nodes[0], "parameters": {"threshold": 3}}, *nodes[1:]]}, {"nodes": [nodes[0]]}, {"nodes": [{"id": "t", "kind": "true-tree"}, nodes[0]]},
    ):
        with pytest.raises(ValueError):
            pipeline.parse(definition(**bad))


def test_failed_routes_leave_the_others_alone(spark):
    signals, failed = pipeline.run(spark, definition())
    assert len(failed) == 1 and failed[0].startswith("mine -> m")
    rows = signals.toPandas()
    assert set(rows["metric"]) == {"p_positive", "p_purifying", "mean_alpha", "mean_beta", "lrt"} and len(rows) == 12 * 5


def test_fingerprint_ignores_plots():
    assert pipeline.fingerprint(definition()) == pipeline.fingerprint(definition(visualization={"a": 1})) != pipeline.fingerprint(definition(id="y"))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(definition(nodes=[{"id": "u", "kind": "user-tree"}, {"id": "m", "kind": "selection", "modelId": "episodic"}]))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fasta").write_text(">x\nATGAAA\n>y\nATGAAG\n>z\nATGCAA\n")
    (tmp_path / "in/a.nwk").write_text("(x:0.1,y:0.1,z:0.2);")
    assert main(["validate", str(tmp_path / "c.json")]) == 0 and main(["methods"]) == 0 and main(["version"]) == 0
    assert main(["validate", str(tmp_path / "none")]) == 1 and main([]) == 1
    assert main(["run", "--config", str(tmp_path / "c.json"), "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out/signals")).count() == 4
    assert "episodic" in capsys.readouterr().out


def test_replot_makes_the_tables_again(spark, tmp_path):
    rows = [("d", "nj", m, metric, str(k), k / 2) for m in ("selection", "episodic") for metric in ("a", "b") for k in range(3)]
    pipeline.write_reports(spark.createDataFrame(rows, pipeline.SIGNAL), str(tmp_path / "one"))
    pipeline.replot(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    pipeline.replot(spark, str(tmp_path / "one"), str(tmp_path / "three"), ["episodic"])
    read = lambda n, t: sorted(map(str, spark.read.option("header", True).csv(str(tmp_path / n / t)).collect()))
    assert all(read("one", t) == read("two", t) for t in ("signals", "catalog", "tables")) and len(read("three", "tables")) == 3
    with pytest.raises(ValueError):
        pipeline.replot(spark, str(tmp_path / "one"), f"{tmp_path}/one/")
