"""Analysis pipelines: a JSON definition, its checks, and a plan of routes that are unioned as long signals."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stages of a pipeline in order, and the node kinds of each.
STAGES = {"input": ("alignment", "tree", "simulator"), "source": ("user-tree", "true-tree", "nj-tree", "tree-hmm", "spr-history", "joint-network"), "selection": ("selection",)}
#: Sources that give each region of an alignment a tree of its own.
REGIONAL = ("tree-hmm", "spr-history", "joint-network")
SIGNAL = "dataset string, source string, method string, metric string, key string, value double"


class Analysis(Protocol):
    """What a method must offer: a manifest and a plan from (sequences, trees, parameters) to signals."""

    manifest: Manifest

    def plan(self, sequences: DataFrame, trees: DataFrame, parameters: dict[str, Any]) -> DataFrame: ...


@dataclass(frozen=True)
class Parameter:
    id: str
    kind: str
    default: Any
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class Manifest:
    id: str
    version: str
    accepts: tuple[str, ...]
    parameters: tuple[Parameter, ...] = ()

    def defaults(self) -> dict[str, Any]:
        return {p.id: p.default for p in self.parameters}

    def checked(self, given: dict[str, Any]) -> dict[str, Any]:
        known = {p.id: p for p in self.parameters}
        for name, value in given.items():
            if name not in known:
                raise ValueError(f"{self.id} has no parameter {name}")
            p = known[name]
            if p.kind == "number" and (not isinstance(value, (int, float)) or p.least is not None and value < p.least or p.most is not None and value > p.most):
                raise ValueError(f"{name} is out of its range")
        return self.defaults() | given


@dataclass
class Method:
    manifest: Manifest
    run: Callable[..., DataFrame]

    def plan(self, sequences: DataFrame, trees: DataFrame, parameters: dict[str, Any]) -> DataFrame:
        return self.run(sequences, trees, **self.manifest.checked(parameters))


def _signals(rows: DataFrame, method: str, metrics: list[str], key: str = "site") -> DataFrame:
    """Wide rows to long signals."""
    long = rows.unpivot(["dataset", key], metrics, "metric", "value")
    return long.select("dataset", F.lit(method).alias("method"), "metric", F.col(key).cast("string").alias("key"), F.col("value").cast("double").alias("value"))


def methods() -> dict[str, Method]:
    from ..operators import analyses as X

    trees = ("user-tree", "true-tree", "nj-tree", *REGIONAL)
    threshold = Parameter("threshold", "number", 0.9, 0, 1)
    return {
        "selection": Method(Manifest("selection", "1", trees, (threshold,)), lambda s, t, **p: _signals(X.site_selection(s, t, **p), "selection", ["p_positive", "p_purifying", "mean_alpha", "mean_beta", "lrt"])),
        "episodic": Method(Manifest("episodic", "1", trees, (Parameter("nodes", "number", 4, 1, 64),)), lambda s, t, **p: _signals(X.episodic_selection(s, t, **p), "episodic", ["p_positive", "bayes_factor"])),
        "gamma": Method(Manifest("gamma", "1", trees, (Parameter("slices", "number", 4, 2, 32),)), lambda s, t, **p: _signals(X.gamma_selection(s, t, **p), "gamma", ["p_positive", "mean_omega"])),
        "branches": Method(Manifest("branches", "1", trees), lambda s, t: _signals(X.branch_selection(s, t), "branches", ["lrt", "p", "adjusted"], "branch")),
    }


@dataclass
class Node:
    id: str
    kind: str
    model: str | None = None
    parameters: dict[str, Any] = field(default_factory=dict)


def stage_of(kind: str) -> str:
    for stage, kinds in STAGES.items():
        if kind in kinds:
            return stage
    raise ValueError(f"there is no node kind {kind}")


def parse(text: str) -> list[Node]:
    """Nodes in order of stages; raises on a wrong version, unknown kinds or parameters, repeated ids, and missing routes."""
    spec = json.loads(text)
    if spec.get("schemaVersion") != 1:
        raise ValueError("schemaVersion must be 1")
    nodes = [Node(n["id"], n["kind"], n.get("modelId"), dict(n.get("parameters", {}))) for n in spec["nodes"]]
    if len({n.id for n in nodes}) < len(nodes):
        raise ValueError("node ids must be unique")
    order = list(STAGES)
    nodes.sort(key=lambda n: order.index(stage_of(n.kind)))
    for kind in ("simulator", "true-tree"):
        if sum(n.kind == kind for n in nodes) > 1:
            raise ValueError(f"at most one {kind}")
    known = methods()
    for n in nodes:
        if n.kind == "selection":
            if n.model not in known:
                raise ValueError(f"there is no method {n.model}")
            known[n.model].manifest.checked(n.parameters)
    if any(n.kind == "true-tree" for n in nodes) and not any(n.kind == "simulator" for n in nodes):
        raise ValueError("a true tree needs a simulator")
    if any(n.kind == "selection" for n in nodes) and not routes(nodes):
        raise ValueError("no source fits a method")
    return nodes


def routes(nodes: list[Node]) -> list[tuple[Node, Node]]:
    """Pairs of source and selection by what the method accepts."""
    known = methods()
    return [(s, m) for s in nodes if stage_of(s.kind) == "source" for m in nodes if m.kind == "selection" and s.kind in known[m.model].manifest.accepts]


def _regional(method: Analysis, sequences: DataFrame, regions: DataFrame, parameters: dict[str, Any]) -> DataFrame:
    """Signals of a method run on every region with its own tree; sites are numbered through the whole alignment, branches by region."""
    from ..operators.analyses import by_region

    cut, trees, where = by_region(sequences, regions)
    found = method.plan(cut, trees, parameters).join(where, "dataset")
    site = found["key"].try_cast("int")
    key = F.when(site.isNotNull(), (site + F.col("first")).cast("string")).otherwise(F.concat(F.col("first") + 1, F.lit(":"), "key"))
    return found.select(F.col("whole").alias("dataset"), "method", "metric", key.alias("key"), "value")


def run(spark: SparkSession, text: str, sequences: DataFrame | None = None, trees: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(signals of all routes in one lazy union, failed routes). A route that can't be planned leaves the others alone."""
    from ..operators import analyses as X

    nodes = parse(text)
    true_trees = None
    for n in nodes:
        if n.kind == "simulator":
            sequences, true_trees, _, _ = X.simulate_datasets(spark, **{"replicates": 1, **n.parameters})
    if sequences is None:
        raise ValueError("there is no alignment")
    source = {
        "user-tree": lambda: trees, "true-tree": lambda: true_trees, "nj-tree": lambda: X.join_trees(sequences), "tree-hmm": lambda: X.hmm_regions(sequences),
        "spr-history": lambda: X.spr_reconstruction(sequences), "joint-network": lambda: X.network_regions(sequences),
    }
    known, out, failed = methods(), None, []
    for s, m in routes(nodes):
        try:
            of = source[s.kind]()
            if of is None:
                raise ValueError("there is no tree")
            found = _regional(known[m.model], sequences, of, m.parameters) if s.kind in REGIONAL else known[m.model].plan(sequences, of, m.parameters)
            found = found.withColumn("source", F.lit(s.id)).select("dataset", "source", "method", "metric", "key", "value")
            out = found if out is None else out.unionByName(found)
        except Exception as e:  # the others go on; what failed is told
            failed.append(f"{s.id} -> {m.id}: {e}")
    return spark.createDataFrame([], SIGNAL) if out is None else out, failed


def fingerprint(text: str) -> str:
    """Hash of a definition without what only changes plots."""
    import hashlib

    spec = json.loads(text)
    spec.pop("visualization", None)
    return hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()


def write_reports(signals: DataFrame, folder: str) -> None:
    """Long table, catalog, and a wide table of each method, as CSV."""
    from ..operators.compare import catalog

    signals.select("dataset", "source", "method", "metric", "key", "value").write.mode("overwrite").option("header", True).csv(f"{folder}/signals")
    catalog(signals).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/catalog")
    wide = signals.groupBy("dataset", "source", "method", "key").pivot("metric").agg(F.first("value"))
    wide.write.mode("overwrite").partitionBy("method").option("header", True).csv(f"{folder}/tables")


def replot(spark: SparkSession, saved: str, folder: str, methods: list[str] | None = None) -> None:
    """Tables made again from a saved run, of some methods or all, without its analyses."""
    if saved.rstrip("/") == folder.rstrip("/"):
        raise ValueError("a run can't be made again in its own folder")
    signals = spark.read.option("header", True).schema(SIGNAL).csv(f"{saved}/signals")
    write_reports(signals if methods is None else signals.filter(F.col("method").isin(methods)), folder)


SCHEMA_OF_DEFINITION = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()), T.StructField("id", T.StringType()),
    T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("modelId", T.StringType()), T.StructField("parameters", T.MapType(T.StringType(), T.StringType()))]))),
])
