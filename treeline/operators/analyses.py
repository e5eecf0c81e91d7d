"""Whole analyses: one alignment is one group of an Arrow plan, many alignments run side by side.

Inputs are rows of (dataset, name, sequence) and (dataset, newick); the kernels see one dataset at a
time, which its alignment bounds. Results are long DataFrames of sites, branches or regions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import sense_codons
from ..kernels import align as align_kernel
from ..kernels import codon, hmm, inference, simulate, topology
from ..sources.parsers import Node, parse_newick, write_newick
from .chains import kept
from .grids import site_rates, transformed_rates


def _grouped(sequences: DataFrame, trees: DataFrame | None, fn, schema: str) -> DataFrame:
    """fn(dataset, names, sequences, newick) -> DataFrame, for each dataset."""
    joined = sequences if trees is None else sequences.join(trees, "dataset")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name")
        out = fn(key[0], rows["name"].tolist(), rows["sequence"].tolist(), rows["newick"].iloc[0] if "newick" in rows else None)
        out.insert(0, "dataset", np.array([key[0]] * len(out), dtype=object))
        return out

    return joined.groupBy("dataset").applyInPandas(run, "dataset string, " + schema)


def _dealt(sequences: DataFrame, trees: DataFrame, parts: int, fn) -> DataFrame:
    """dataset, names, rows, newick, part, logl of fn(dataset, names, sequences, newick, part), a matrix: an alignment's grid is dealt to many tasks in parts."""
    packed = sequences.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("name", "sequence"))).alias("rows")).join(trees, "dataset")
    tasks = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(max(1, sequences.sparkSession.sparkContext.defaultParallelism), "dataset", "part")

    def run(batches):
        for batch in batches:
            for dataset, rows, newick, part in zip(batch["dataset"], batch["rows"], batch["newick"], batch["part"], strict=True):
                names, texts = [r["name"] for r in rows], [r["sequence"] for r in rows]
                logl = np.ascontiguousarray(fn(dataset, names, texts, newick, int(part)), dtype=np.float64)
                yield pd.DataFrame({"dataset": [dataset], "newick": [newick], "part": [int(part)], "sites": [logl.shape[1]], "logl": [logl.tobytes()]})

    return tasks.mapInPandas(run, "dataset string, newick string, part int, sites int, logl binary")


def _joined(parts: DataFrame, fn, schema: str) -> DataFrame:
    """fn(dataset, logl) -> DataFrame on the stacked parts of each dataset."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        logl = np.concatenate([np.frombuffer(x, np.float64).reshape(-1, n) for x, n in zip(rows["logl"], rows["sites"], strict=True)])
        out = fn(key[0], logl)
        out.insert(0, "dataset", np.array([key[0]] * len(out), dtype=object))
        return out

    return parts.groupBy("dataset").applyInPandas(run, "dataset string, " + schema)


def _prepared(names: list[str], sequences: list[str], newick: str):
    tree = codon.Tree(parse_newick(newick))
    by_name = dict(zip(names, sequences, strict=True))
    missing = [tree.nodes[k].name for k in tree.tips if tree.nodes[k].name not in by_name]
    if missing:
        raise ValueError(f"no sequence for {missing[0]}")
    rates, _ = codon.empirical_gtr(sequences)
    model = codon.CodonModel(rates, codon.f3x4(sequences))
    states = np.stack([model.states(by_name[tree.nodes[k].name]) for k in tree.tips])
    return tree, model, states


def fit_scale(tree: codon.Tree, model: codon.CodonModel, states: np.ndarray) -> tuple[float, float]:
    """(branch scale, beta) that fit best with alpha 1: the shared part of a global fit."""

    def f(scale: float, beta: float) -> float:
        kept = tree.length
        tree.length = kept * scale
        try:
            return float(codon.grid_likelihood(tree, model, states, np.array([1.0]), np.array([beta])).sum())
        finally:
            tree.length = kept

    at, _ = inference.stencil_search(f, (1.0, 0.5), 0.7, 6)
    return at


def site_selection(sequences: DataFrame, trees: DataFrame, method: str = "em", threshold: float = 0.9, concentration: float = 0.5, fit: bool = True, seed: int = 1, rates: list[float] | None = None, block: int = 40) -> DataFrame:
    """Site posteriors of alpha and beta under a mixture over the grid rates x rates (20 x 20 by default), with a likelihood ratio of alpha = beta from the same surface.

    The grid of one alignment is dealt to tasks in blocks; what joins them is categories x sites of one alignment.
    """
    axis = np.array(site_rates() if rates is None else rates)
    a, b = (v.ravel() for v in np.meshgrid(axis, axis, indexing="ij"))
    if fit:
        trees = scaled_trees(sequences, trees)

    def part(dataset, names, rows, newick, k):
        tree, model, states = _prepared(names, rows, newick)
        at = slice(k * block, (k + 1) * block)
        return codon.grid_likelihood(tree, model, states, a[at], b[at], block)

    def infer(dataset, logl):
        l = inference.normal_columns(logl)  # noqa: E741
        theta = inference.dirichlet_em(l, concentration) if method == "em" else inference.gibbs(l, concentration, seed=seed)[0]
        post = theta[:, None] * l
        post /= post.sum(0)
        p, q = post[b > a].sum(0), post[b < a].sum(0)
        fel = [inference.approximate_fel(logl[:, k].reshape(len(axis), len(axis)), axis, axis) for k in range(logl.shape[1])]
        out = pd.DataFrame({"site": np.arange(1, len(p) + 1, dtype=np.int32), "p_positive": p, "p_purifying": q, "mean_alpha": a @ post, "mean_beta": b @ post})
        out["selection"] = np.where(p > threshold, "positive", np.where(q > threshold, "purifying", "neutral"))
        out["lrt"] = [f["lrt"] for f in fel]
        out["direction"] = np.array([f["direction"] for f in fel], np.int32)
        return out

    found = _dealt(sequences, trees, -(-len(a) // block), part)
    return _joined(found, infer, "site int, p_positive double, p_purifying double, mean_alpha double, mean_beta double, selection string, lrt double, direction int")


def scaled_trees(sequences: DataFrame, trees: DataFrame) -> DataFrame:
    """dataset, newick with all branches multiplied by the scale that fits each alignment best."""

    def run(dataset, names, rows, newick):
        tree, model, states = _prepared(names, rows, newick)
        scale = fit_scale(tree, model, states)[0]
        for node in tree.nodes:
            node.length = (node.length or 0.0) * scale
        return pd.DataFrame({"newick": [write_newick(tree.nodes[0])]})

    return _grouped(sequences, trees, run, "newick string")


def conditional_grid(sequences: DataFrame, trees: DataFrame, grid: DataFrame, block: int = 96) -> DataFrame:
    """dataset, category, site, logl over a grid of (category, alpha, beta), with the grid of one alignment dealt to many tasks in blocks."""
    packed = sequences.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("name", "sequence"))).alias("rows")).join(trees, "dataset")
    cell = F.struct("category", "alpha", "beta")
    blocks = grid.groupBy(F.floor(F.col("category") / block).alias("block")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    spark = sequences.sparkSession
    tasks = packed.crossJoin(F.broadcast(blocks)).repartition(max(1, spark.sparkContext.defaultParallelism), "dataset", "block")

    def run(batches):
        known: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for dataset, rows, newick, cells in zip(batch["dataset"], batch["rows"], batch["newick"], batch["cells"], strict=True):
                if dataset not in known:
                    known = {dataset: _prepared([r["name"] for r in rows], [r["sequence"] for r in rows], newick)}
                tree, model, states = known[dataset]
                logl = codon.grid_likelihood(tree, model, states, np.array([c["alpha"] for c in cells]), np.array([c["beta"] for c in cells]), block)
                out += [(dataset, int(c["category"]), x) for c, x in zip(cells, logl, strict=True)]
            yield pd.DataFrame(out, columns=["dataset", "category", "logl"])

    table = tasks.mapInPandas(run, "dataset string, category int, logl array<double>")
    return table.select("dataset", "category", F.posexplode("logl").alias("at", "logl")).select("dataset", "category", (F.col("at") + 1).alias("site"), "logl")


def two_group_selection(
    sequences: DataFrame, trees: DataFrame, draws: int = 2500, seed: int = 1, alphas: list[float] | None = None, omegas: list[float] | None = None, background: list[float] | None = None
) -> DataFrame:
    """Posteriors of two branch classes' ratios: branches tagged with the first tag in order, with the second, and the rest.

    The grid is alphas x omegas x omegas x background, by default 12 transformed rates up to 13 for each and 7 up to 6
    for the rest; each alpha is a task of its own.
    """
    alphas = transformed_rates(0.01, 13, 6) if alphas is None else alphas
    omegas = transformed_rates(0.01, 13, 6) if omegas is None else omegas
    background = transformed_rates(0.05, 6, 4) if background is None else background
    a, w1, w2, _ = (v.ravel() for v in np.meshgrid(alphas, omegas, omegas, background, indexing="ij"))

    def part(dataset, names, rows, newick, k):
        tree, model, states = _prepared(names, rows, newick)
        tags = sorted({n.tag for n in tree.nodes if n.tag})[:2]
        group = [tags.index(n.tag) if n.tag in tags else 2 for n in tree.nodes]
        logl = codon.class_grid_likelihood(tree, model, states, group, alphas[k], [omegas, omegas, background])
        return logl.reshape(-1, logl.shape[-1])

    def infer(dataset, logl):
        _, counts = inference.gibbs_rejection(inference.normal_columns(logl), draws=draws, burn=draws // 5, seed=seed)
        mass = counts / counts.sum(0)
        return pd.DataFrame({
            "site": np.arange(1, logl.shape[1] + 1, dtype=np.int32), "p_first_greater": mass[w1 > w2].sum(0), "p_second_greater": mass[w2 > w1].sum(0),
            "p_first_positive": mass[w1 > 1 + 1e-9].sum(0), "p_second_positive": mass[w2 > 1 + 1e-9].sum(0), "mean_alpha": a @ mass, "mean_first": w1 @ mass, "mean_second": w2 @ mass,
        })

    schema = "site int, p_first_greater double, p_second_greater double, p_first_positive double, p_second_positive double, mean_alpha double, mean_first double, mean_second double"
    return _joined(_dealt(sequences, trees, len(alphas), part), infer, schema)


def episodic_selection(sequences: DataFrame, trees: DataFrame, nodes: int = 4, alphas: list[float] | None = None, lows: list[float] | None = None, highs: list[float] | None = None) -> DataFrame:
    """Two-rate mixtures on every branch: posterior that the second ratio exceeds 1, with an empirical Bayes factor.

    The grid is alphas x lows x highs, by default 8 x 8 x 8 transformed rates up to 10, 1 and 10.
    """
    alphas = transformed_rates(0.01, 10, 4) if alphas is None else alphas
    lows = transformed_rates(0.01, 1, 7) if lows is None else lows
    highs = transformed_rates(0.01, 10, 4) if highs is None else highs

    def run(dataset, names, rows, newick):
        tree, model, states = _prepared(names, rows, newick)
        x, w = np.polynomial.legendre.leggauss(nodes)
        x, w = (x + 1) / 2, w / 2
        cells = [(a, low, high) for a in alphas for low in lows for high in highs]
        logl = []
        for a, low, high in cells:
            parts = [codon.mixture_likelihood(tree, model, states, [(1 - p, a, a * low), (p, a, a * high)]) + np.log(q) for p, q in zip(x, w, strict=True)]
            logl.append(np.logaddexp.reduce(parts, axis=0))
        l = inference.normal_columns(np.array(logl))  # noqa: E741
        theta = inference.dirichlet_em(l)
        post = theta[:, None] * l
        post /= post.sum(0)
        a, low, high = np.array(cells).T
        above = high > 1 + 1e-9  # the transform of 1 need not be 1
        p, prior = post[above].sum(0), float(np.clip(theta[above].sum(), 1e-9, 1 - 1e-9))
        bf = np.minimum(p, 1 - 1e-12) / np.maximum(1 - p, 1e-12) / (prior / (1 - prior))
        return pd.DataFrame({"site": np.arange(1, len(p) + 1, dtype=np.int32), "p_positive": p, "bayes_factor": bf, "mean_alpha": a @ post, "mean_low": (a * low) @ post, "mean_high": (a * high) @ post, "detected": bf > 100})

    return _grouped(sequences, trees, run, "site int, p_positive double, bayes_factor double, mean_alpha double, mean_low double, mean_high double, detected boolean")


def gamma_selection(sequences: DataFrame, trees: DataFrame, slices: int = 20, alphas: list[float] | None = None, means: list[float] | None = None, shapes: list[float] | None = None) -> DataFrame:
    """Branch ratios from a gamma distribution at each site, with and without ratios above 1: posterior of positive selection and of slices above 1.

    Each branch is the mean over slices at the distribution's mid-quantiles; capped categories cut those at 1. The grid is
    means x 2 x shapes x alphas, by default transformed rates up to 16, 20 and 10; each mean is a task of its own.
    """
    alphas = transformed_rates(0.01, 10, 8) if alphas is None else alphas
    means = transformed_rates(0.01, 16, 8) if means is None else means
    shapes = transformed_rates(0.05, 20, 6) if shapes is None else shapes
    unit = {s: np.array([inference.gamma_quantile((i + 0.5) / slices, s) for i in range(slices)]) for s in shapes}
    mixtures = lambda mu: [np.minimum(unit[s] * mu, 1.0) if cap else unit[s] * mu for cap in (False, True) for s in shapes]

    def part(dataset, names, rows, newick, k):
        tree, model, states = _prepared(names, rows, newick)
        logl = codon.slice_mixture_likelihood(tree, model, states, alphas, mixtures(means[k]))
        return logl.reshape(-1, logl.shape[-1])

    mu, cap, shape, a = (v.ravel() for v in np.meshgrid(means, [False, True], shapes, alphas, indexing="ij"))
    above = np.repeat([float((m > 1).mean()) for mean in means for m in mixtures(mean)], len(alphas))

    def infer(dataset, logl):
        l = inference.normal_columns(logl)  # noqa: E741
        theta = inference.dirichlet_em(l)
        post = theta[:, None] * l
        post /= post.sum(0)
        p, free = post[above > 0].sum(0), post[~cap].sum(0)
        prior = float(np.clip(theta[above > 0].sum(), 1e-9, 1 - 1e-9))
        bf = np.minimum(p, 1 - 1e-12) / np.maximum(1 - p, 1e-12) / (prior / (1 - prior))
        mean = mu @ post
        return pd.DataFrame({
            "site": np.arange(1, l.shape[1] + 1, dtype=np.int32), "p_positive": p, "p_uncapped": free, "bayes_factor": bf, "mean_alpha": a @ post, "mean_omega": mean,
            "mean_shape": shape @ post, "sd_omega": (mu / np.sqrt(shape)) @ post, "branch_fraction": above @ post,
        })

    schema = "site int, p_positive double, p_uncapped double, bayes_factor double, mean_alpha double, mean_omega double, mean_shape double, sd_omega double, branch_fraction double"
    return _joined(_dealt(sequences, trees, len(means), part), infer, schema)


def branch_selection(sequences: DataFrame, trees: DataFrame, scope: str = "all") -> DataFrame:
    """Tests of each branch for a class of sites above neutrality: likelihood ratio, p and step-down adjusted p.

    Each branch's operator is replaced in place by messages, so a test costs one product for a site, not a pass of the tree.
    """

    def run(dataset, names, rows, newick):
        tree, model, states = _prepared(names, rows, newick)
        columns, at = codon.compress(states)
        weight = np.bincount(at, minlength=columns.shape[1])
        tips = {k: codon.tip_vectors(columns[i], len(model.pi)) for i, k in enumerate(tree.tips)}
        base = lambda k: 0.7 * model.transition(1.0, 0.1, float(tree.length[k])) + 0.3 * model.transition(1.0, 1.0, float(tree.length[k]))
        down, up, _ = codon.messages(tree, tips, base, model.pi)
        out = []
        for k in range(1, len(tree.nodes)):
            tip = not tree.children[k]
            if scope == "internal" and tip or scope == "terminal" and not tip:
                continue
            t = max(float(tree.length[k]), 1e-6)

            def value(raw, t=t, k=k, top=None):
                low, share = 1 / (1 + np.exp(-raw[0])), 1 / (1 + np.exp(-raw[1]))
                high = 1.0 if top else 1 + np.exp(np.clip(raw[2], -10, 3))
                p = share * model.transition(1.0, round(float(low), 6), t) + (1 - share) * model.transition(1.0, round(float(high), 6), t)
                return float(weight @ np.log(np.maximum((up[k] * (p @ down[k])).sum(0), 1e-300)))

            null, l0 = inference.nelder_mead(lambda r: value(r, top=True), np.array([-1.0, 1.0]), 1.0, 25)  # noqa: B023
            best, l1 = inference.nelder_mead(value, np.array([null[0], null[1], 0.0]), 1.0, 35)
            lrt = max(0.0, 2 * (l1 - l0))
            out.append((k, tree.nodes[k].name or f"node{k}", t, float(1 / (1 + np.exp(-best[0]))), float(1 + np.exp(np.clip(best[2], -10, 3))), float(1 - 1 / (1 + np.exp(-best[1]))), lrt))
        frame = pd.DataFrame(out, columns=["node_id", "branch", "length", "omega_low", "omega_high", "share_high", "lrt"])
        return frame.astype({"node_id": "int32"})

    tested = _grouped(sequences, trees, run, "node_id int, branch string, length double, omega_low double, omega_high double, share_high double, lrt double")
    from ..functions.scalars import branch_test_p
    from .windows import holm

    adjusted = holm(tested.withColumn("p", branch_test_p(F.col("lrt"))), ["dataset"], "p", "node_id")
    return adjusted.withColumn("significant", F.col("adjusted") <= 0.05)


def branch_site_scan(sequences: DataFrame, trees: DataFrame, omega: float = 4.0) -> DataFrame:
    """Evidence (log ratio) of each branch and site for a raised ratio on that branch alone, from two message families."""

    def run(dataset, names, rows, newick):
        tree, model, states = _prepared(names, rows, newick)
        columns, at = codon.compress(states)
        tips = {k: codon.tip_vectors(columns[i], len(model.pi)) for i, k in enumerate(tree.tips)}
        base = lambda k: model.transition(1.0, 0.3, float(tree.length[k]))
        down, up, logl = codon.messages(tree, tips, base, model.pi)
        parts = []
        for k in range(1, len(tree.nodes)):
            raised = np.log(np.maximum((up[k] * (model.transition(1.0, omega, float(tree.length[k])) @ down[k])).sum(0), 1e-300)) - logl
            parts.append(pd.DataFrame({"node_id": np.int32(k), "branch": tree.nodes[k].name or f"node{k}", "site": np.arange(1, len(at) + 1, dtype=np.int32), "log_ratio": raised[at]}))
        return pd.concat(parts)

    return _grouped(sequences, trees, run, "node_id int, branch string, site int, log_ratio double")


def clade_shift_scan(
    sequences: DataFrame, trees: DataFrame, intensities: tuple[float, ...] = (0.4, 0.7, 1 / 0.7, 2.5), points: int = 16, components: int = 96, mass: float = 0.9, block: int = 32
) -> DataFrame:
    """Log likelihood of each site if the ratio changes to omega^k below a branch for good, for every branch and k, and without change (node_id 0).

    The baseline is a points x points grid of rates: its posterior without change is cut, for each site, to the categories that
    hold ``mass`` of it (``components`` at most), and a site's likelihood of a change is its mean over those, so baseline
    uncertainty is integrated. The grid is dealt to tasks in blocks, and so is the scan.
    """
    axis = np.array(site_rates(points))
    a, b = (v.ravel() for v in np.meshgrid(axis, axis, indexing="ij"))
    parts = -(-len(a) // block)

    def grid(dataset, names, rows, newick, k):
        tree, model, states = _prepared(names, rows, newick)
        return codon.grid_likelihood(tree, model, states, a[k * block : (k + 1) * block], b[k * block : (k + 1) * block], block)

    def baseline(dataset, logl):
        l = inference.normal_columns(logl)  # noqa: E741
        post = inference.dirichlet_em(l)[:, None] * l
        post /= post.sum(0)
        order = np.argsort(-post, axis=0, kind="stable")
        out = []
        for site in range(post.shape[1]):
            p = post[order[:, site], site]
            n = min(components, int(np.searchsorted(np.cumsum(p), mass)) + 1)
            out.append(pd.DataFrame({"site": np.int32(site), "category": order[:n, site].astype(np.int32), "weight": p[:n] / p[:n].sum()}))
        return pd.concat(out)

    kept = _joined(_dealt(sequences, trees, parts, grid), baseline, "site int, category int, weight double")
    kept = kept.groupBy("dataset", F.expr(f"int(category div {block})").alias("part")).agg(F.collect_list(F.struct("site", "category", "weight")).alias("kept"))
    packed = sequences.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("name", "sequence"))).alias("rows")).join(trees, "dataset").join(kept, "dataset")

    def scan(batches):
        for batch in batches:
            for dataset, rows, newick, cells in zip(batch["dataset"], batch["rows"], batch["newick"], batch["kept"], strict=True):
                tree, model, states = _prepared([r["name"] for r in rows], [r["sequence"] for r in rows], newick)
                by_category: dict[int, list[tuple[int, float]]] = {}
                for c in cells:
                    by_category.setdefault(int(c["category"]), []).append((int(c["site"]), float(c["weight"])))
                out = []
                for category, held in by_category.items():
                    sites, weight = np.array([h[0] for h in held]), np.array([h[1] for h in held])
                    tips = {k: codon.tip_vectors(states[i, sites], len(model.pi)) for i, k in enumerate(tree.tips)}
                    alpha, omega = float(a[category]), float(b[category] / max(a[category], 1e-9))
                    p = lambda k, w: model.transition(alpha, alpha * w, float(tree.length[k]))  # noqa: B023, E731
                    down, up, logl = codon.messages(tree, tips, lambda k: p(k, omega), model.pi)  # noqa: B023
                    out.append((0, 1.0, sites, weight, logl))
                    for intensity in intensities:
                        shifted = float(np.exp(np.clip(np.log(max(omega, 1e-9)) * intensity, -12, 12)))
                        inside, _, _ = codon.messages(tree, tips, lambda k: p(k, shifted), model.pi)  # noqa: B023
                        for k in range(1, len(tree.nodes)):
                            out.append((k, intensity, sites, weight, np.log(np.maximum((up[k] * (p(k, shifted) @ inside[k])).sum(0), 1e-300))))
                    model._known.clear()
                yield pd.concat([pd.DataFrame({"dataset": dataset, "node_id": np.int32(k), "k": float(v), "site": (s + 1).astype(np.int32), "weight": w, "logl": x}) for k, v, s, w, x in out])

    parts_of = packed.repartition(max(1, sequences.sparkSession.sparkContext.defaultParallelism), "dataset", "part")
    cells = parts_of.select("dataset", "rows", "newick", "kept").mapInPandas(scan, "dataset string, node_id int, k double, site int, weight double, logl double")
    # the mean over a site's categories, in logarithms
    top = F.max("logl").over(Window.partitionBy("dataset", "site"))
    shifted = cells.withColumn("top", top).groupBy("dataset", "node_id", "k", "site").agg(F.max("top").alias("top"), F.sum(F.col("weight") * F.exp(F.col("logl") - F.col("top"))).alias("mean"))
    return shifted.select("dataset", "node_id", "k", "site", (F.col("top") + F.log(F.greatest("mean", F.lit(1e-300)))).alias("logl"))


def join_trees(sequences: DataFrame) -> DataFrame:
    """dataset, newick by neighbour joining of Jukes-Cantor distances."""
    return _grouped(sequences, None, lambda d, names, rows, _: pd.DataFrame({"newick": [write_newick(topology.nj_tree(names, rows))]}), "newick string")


def seed_trees(sequences: DataFrame, least: int = 60) -> DataFrame:
    def run(d, names, rows, _):
        found = topology.seed_trees(names, rows, least)
        return pd.DataFrame({"seed": np.arange(len(found), dtype=np.int32), "newick": [write_newick(t) for t in found], "signature": [topology.signature(topology.nested(t)) for t in found]})

    return _grouped(sequences, None, run, "seed int, newick string, signature string")


def tree_profiles(sequences: DataFrame, seeds: DataFrame) -> DataFrame:
    """dataset, seed, site, logl: nucleotide likelihood of each site under each seed tree with fixed lengths."""
    packed = seeds.groupBy("dataset").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seed", "newick")))).alias("newick"))

    def run(d, names, rows, text):
        import json

        rates, pi = codon.empirical_gtr(rows)
        system = codon.Reversible(codon.gtr_matrix(rates, pi), pi)
        by_name, parts = dict(zip(names, rows, strict=True)), []
        for item in json.loads(text):
            tree = codon.Tree(parse_newick(item["newick"]))
            states = np.stack([np.array(["ACGT".find(c) for c in by_name[tree.nodes[k].name]]) for k in tree.tips])
            columns, at = codon.compress(states)
            tips = {k: codon.tip_vectors(columns[i], 4) for i, k in enumerate(tree.tips)}
            logl = codon.prune(tree, tips, lambda k: system.p(max(float(tree.length[k]), 1e-6)), pi)[at]  # noqa: B023
            parts.append(pd.DataFrame({"seed": np.int32(item["seed"]), "site": np.arange(1, len(logl) + 1, dtype=np.int32), "logl": logl}))
        return pd.concat(parts)

    return _grouped(sequences, packed, run, "seed int, site int, logl double")


def tree_segments(profiles: DataFrame, expected: tuple[float, ...] = (1.0, 3.0, 9.0), least: int = 10) -> DataFrame:
    """dataset, start, end, state: regions of the tree HMM over (dataset, site, state, logl)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="site", columns="state", values="logl").sort_index()
        fit = hmm.fit_trees(wide.to_numpy(), list(expected))
        path = hmm.merge_short_runs(fit["path"], wide.to_numpy(), least)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
        sites, states = wide.index.to_numpy(), wide.columns.to_numpy()
        return pd.DataFrame({"dataset": key[0], "start": [int(sites[a]) for a in edges[:-1]], "end": [int(sites[b - 1]) for b in edges[1:]], "state": [int(states[path[a]]) for a in edges[:-1]]})

    return profiles.groupBy("dataset").applyInPandas(run, "dataset string, start int, end int, state int")


def low_switch_segments(profiles: DataFrame, resets: float = 4.0, least: int = 10) -> DataFrame:
    """dataset, start, end, state of a chain with even weights from which states go that its best path leaves out, until none does."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="site", columns="state", values="logl").sort_index()
        _, path = hmm.low_switch_states(wide.to_numpy(), 1 - np.exp(-resets / max(1, len(wide) - 1)), least)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
        sites, states = wide.index.to_numpy(), wide.columns.to_numpy()
        return pd.DataFrame({"dataset": key[0], "start": [int(sites[a]) for a in edges[:-1]], "end": [int(sites[b - 1]) for b in edges[1:]], "state": [int(states[path[a]]) for a in edges[:-1]]})

    return profiles.groupBy("dataset").applyInPandas(run, "dataset string, start int, end int, state int")


def hmm_regions(sequences: DataFrame, least: int = 30) -> DataFrame:
    """dataset, start, end, newick: regions of the tree HMM over trees that windows of the alignment suggest."""
    seeds = seed_trees(sequences)
    profiles = tree_profiles(sequences, seeds).select("dataset", "site", F.col("seed").alias("state"), "logl")
    found = tree_segments(profiles, least=least)
    return found.join(seeds.select("dataset", F.col("seed").alias("state"), "newick"), ["dataset", "state"]).select("dataset", "start", "end", "newick")


def by_region(sequences: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences, trees, where) of every region as a dataset of its own: where has dataset, whole, first.

    A codon belongs to the region of its middle base; a region without one is left out. ``first`` is the whole alignment's
    number of the region's first codon, less one.
    """
    first, last = F.ceil((F.col("start") + 1) / 3).cast("int"), F.floor((F.col("end") + 1) / 3).cast("int")
    named = regions.select(F.col("dataset").alias("whole"), first.alias("_a"), last.alias("_b"), "newick").filter("_b >= _a").withColumn("dataset", F.concat("whole", F.lit("#"), "_a"))
    cut = sequences.withColumnRenamed("dataset", "whole").join(named.select("whole", "dataset", "_a", "_b"), "whole")
    cut = cut.select("dataset", "name", F.expr("substring(sequence, 3 * (_a - 1) + 1, 3 * (_b - _a + 1))").alias("sequence")).filter("length(sequence) > 0")
    return cut, named.select("dataset", "newick"), named.select("dataset", "whole", (F.col("_a") - 1).alias("first"))


def spr_reconstruction(sequences: DataFrame, window: int = 60, jump: float = 4.0, least: int = 30) -> DataFrame:
    """dataset, start, end, newick: cheapest path of parsimony over candidate topologies, changes priced by clade distance."""

    def run(d, names, rows, _):
        trees = [topology.canonical(topology.nested(t)) for t in topology.seed_trees(names, rows, window)]
        masks = {n: np.array([1 << "ACGT".find(c) if c in "ACGT" else 0 for c in s]) for n, s in zip(names, rows, strict=True)}
        cost = np.stack([topology.fitch(t, masks) for t in trees], axis=1).astype(float)
        steps = np.array([[jump * topology.clade_distance(a, b) / 2 for b in trees] for a in trees])
        path, _total = hmm.semi_markov(cost, steps, min(least, len(cost)))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
        return pd.DataFrame({"start": (edges[:-1] + 1).astype(np.int32), "end": edges[1:].astype(np.int32), "newick": [topology.unit_newick(trees[path[a]]) for a in edges[:-1]]})

    return _grouped(sequences, None, run, "start int, end int, newick string")


def simulate_datasets(spark: SparkSession, replicates: int, seed: int = 1, **options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sequences, trees, truth, regions) of so many replicates, each seeded on its own."""
    schema = "dataset string, sequences array<struct<name:string,sequence:string>>, newick string, truth array<struct<site:int,alpha:double,omega:double>>, regions array<struct<start:int,end:int,newick:string>>"

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch["id"]:
                d = simulate.dataset(simulate.replicate_seed(seed, int(r)), **options)
                rows.append((f"r{r}", [{"name": n, "sequence": s} for n, s in zip(d["names"], d["sequences"], strict=True)], d["newick"], [{"site": s, "alpha": a, "omega": w} for s, a, w in d["truth"]], [{"start": a, "end": b, "newick": t} for a, b, t in d["regions"]]))
            yield pd.DataFrame(rows, columns=["dataset", "sequences", "newick", "truth", "regions"])

    packed = spark.range(replicates, numPartitions=max(1, min(replicates, 64))).mapInPandas(run, schema)
    return packed.select("dataset", F.inline("sequences")), packed.select("dataset", "newick"), packed.select("dataset", F.inline("truth")), packed.select("dataset", F.inline("regions"))


#: Scores of profiles are whole parts of this where frequencies are those of up to eight letters.
_WHOLE = 840
#: Price of a gap, and of each place that it goes on.
_OPENING, _EXTENSION = -10.0, -0.5


def _profile_matrix(sites: np.ndarray, letters: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """[place, amino acid] frequencies, a place for each site there is."""
    aa = {c: k for k, c in enumerate(align_kernel.AMINO)}
    at, place = np.unique(sites, return_inverse=True)
    m, known = np.zeros((len(at), 20)), np.array([aa.get(c, -1) for c in letters], int)
    m[place[known >= 0], known[known >= 0]] = np.asarray(shares, float)[known >= 0]
    return m


def align_profiles(profiles: DataFrame, chains: DataFrame, block: int = 16384, lead: int = 2048) -> DataFrame:
    """profile, chain, score, pairs of every chain against every profile: local affine alignments.

    All cells count, so the time is the product of the lengths; a task holds a few numbers for each place of the profile. Chains are cut
    into blocks of letters that are done at once. A block begins ``lead`` letters early, with nothing open; once its scores and open gaps
    at its first letter are those that the block before ends with, it goes on as the whole chain would. Chains with a block
    where they aren't are done again from four times as early.
    """
    row = F.struct("codon_site", "aa", "frequency")
    blocks = profiles.groupBy("profile", F.floor(F.col("codon_site") / 4096).alias("blk")).agg(F.array_sort(F.collect_list(row)).alias("cells"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for profile, blk, *cells in batch.itertuples(index=False):
                scores = align_kernel.profile_scores(_profile_matrix(*cells), align_kernel.AMINO + "X") * _WHOLE
                parts = np.rint(scores)
                out.append((profile, blk, parts.T.astype("<i4").tobytes(), bool(np.abs(parts - scores).max() < 1e-6)))
            yield pd.DataFrame(out, columns=["profile", "blk", "scores", "whole"])

    arrays = [F.col(f"cells.{c}").alias(n) for c, n in (("codon_site", "sites"), ("aa", "letters"), ("frequency", "shares"))]
    held = kept(blocks.select("profile", "blk", *arrays).mapInPandas(packed, "profile string, blk long, scores binary, whole boolean"))
    if not held.agg(F.coalesce(F.bool_and("whole"), F.lit(True))).first()[0]:
        return _align_whole(profiles, chains)
    done, todo, keys = None, kept(held.select("profile").distinct().crossJoin(chains.select("chain", "residues"))), ["profile", "chain"]
    while True:
        found = kept(_profile_blocks(held, todo, block, lead))
        order = Window.partitionBy(*keys).orderBy("blk")
        same = found.withColumn("same", (F.col("blk") == 0) | F.coalesce(F.col("began") == F.lag("ended").over(order), F.lit(False)))
        best = same.groupBy(*keys).agg(F.max(F.struct("best", (-F.col("place")).alias("place"), (-F.col("letter")).alias("letter"), "pairs")).alias("b"), F.bool_and("same").alias("same"))
        judged = best.select(*keys, (F.col("b.best") / F.lit(float(_WHOLE))).alias("score"), F.col("b.pairs").alias("pairs"), (F.col("same") & (F.col("b.pairs") >= 0)).alias("fine"))
        fine = judged.filter("fine").drop("fine")
        done = fine if done is None else done.unionByName(fine)
        again = judged.filter("NOT fine").select(*keys)
        if again.isEmpty():
            return done
        todo, lead = todo.join(again, keys, "left_semi"), 4 * lead


def _profile_blocks(held: DataFrame, todo: DataFrame, block: int, lead: int) -> DataFrame:
    """For each block of a chain's letters: its best score, where that is, its way back, and digests of the state that it began and ended with."""
    slots = 4 * max(1, todo.sparkSession.sparkContext.defaultParallelism)
    at = F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.length("residues") - 1, F.lit(0)) / block))
    cut = todo.select("profile", "chain", "residues", F.explode(at).alias("blk")).withColumn("early", F.least(F.col("blk") * block, F.lit(lead)))
    pieces = cut.select("profile", "chain", "blk", "early", F.expr(f"substring(residues, int(blk * {block} - early + 1), int(early + {block}))").alias("text"))
    pieces = pieces.withColumn("slot", F.pmod(F.xxhash64("profile", "chain") + F.col("blk"), F.lit(slots)))
    needed = pieces.select(F.col("slot").alias("part"), F.col("profile").alias("own")).distinct()  # slots bound it
    opening, extension = int(_OPENING * _WHOLE), int(_EXTENSION * _WHOLE)

    def digest(state: tuple[np.ndarray, np.ndarray]) -> bytes:
        return hashlib.blake2b(b"".join(x.astype("<i8").tobytes() for x in state), digest_size=16).digest()

    def run(key: tuple, profile: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        parts = profile.sort_values("blk")["scores"]
        scores = np.concatenate([np.frombuffer(x, "<i4").reshape(21, -1) for x in parts], 1)
        number = np.full(128, 20)
        number[[ord(c) for c in align_kernel.AMINO]] = np.arange(20)
        out = []
        for name, blk, early, text in zip(mine["chain"], mine["blk"], mine["early"], mine["text"], strict=True):
            letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            letters = np.where(letters < 128, number[np.minimum(letters, 127)], 20)
            for kind in (np.int32, np.int64):
                try:
                    state = align_kernel.local_end(scores.astype(kind, copy=False), letters[:early], opening, extension)[3]
                    began = digest(state)
                    best, place, letter, state = align_kernel.local_end(scores.astype(kind, copy=False), letters[early:], opening, extension, state)
                    break
                except OverflowError:
                    continue
            pairs = align_kernel.way_back(scores, letters, place, early + letter, _WHOLE, _OPENING, _EXTENSION, blk * block == early) if best else 0
            out.append((key[1], name, blk, best, place, blk * block + letter, pairs, began, digest(state)))
        return pd.DataFrame(out, columns=["profile", "chain", "blk", "best", "place", "letter", "pairs", "began", "ended"])

    sides = held.join(F.broadcast(needed), F.col("profile") == F.col("own")).select(F.col("part").alias("slot"), F.col("own").alias("profile"), "blk", "scores").groupBy("slot", "profile")
    schema = "profile string, chain string, blk long, best long, place long, letter long, pairs long, began binary, ended binary"
    return sides.cogroup(pieces.groupBy("slot", "profile")).applyInPandas(run, schema)


def _align_whole(profiles: DataFrame, chains: DataFrame) -> DataFrame:
    """``align_profiles`` of any frequencies: all cells of a pair in one task, a row at a time."""
    rows = profiles.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("codon_site", "aa", "frequency"))).alias("cells")).crossJoin(chains)

    def run(batches):
        for batch in batches:
            out = []
            for profile, cells, chain, residues in zip(batch["profile"], zip(batch["sites"], batch["letters"], batch["shares"], strict=True), batch["chain"], batch["residues"], strict=True):
                m = _profile_matrix(*cells)
                letters, column = np.unique(np.array(list(residues)), return_inverse=True)
                s = align_kernel.profile_scores(m, "".join(letters)) if len(letters) else np.zeros((len(m), 0))
                score, extent = align_kernel.local_extent(len(m), lambda i: s[i, column], len(residues))  # noqa: B023
                out.append((profile, chain, score, extent))
            yield pd.DataFrame(out, columns=["profile", "chain", "score", "pairs"])

    arrays = [F.col(f"cells.{c}").alias(n) for c, n in (("codon_site", "sites"), ("aa", "letters"), ("frequency", "shares"))]
    dealt = rows.select("profile", *arrays, "chain", "residues").repartition(max(1, chains.sparkSession.sparkContext.defaultParallelism), "profile", "chain")
    return dealt.mapInPandas(run, "profile string, chain string, score double, pairs long")


def prune_to_taxa(root: Node, keep: set[str]) -> Node | None:
    """A parsed tree cut to some tips, with lengths of suppressed nodes added up."""
    if not root.children:
        return root if root.name in keep else None
    kids = [k for c in root.children if (k := prune_to_taxa(c, keep)) is not None]
    if not kids:
        return None
    if len(kids) == 1:
        kids[0].length = (kids[0].length or 0) + (root.length or 0)
        return kids[0]
    return Node(root.name, root.length, root.tag, kids)


def _network(names, rows, switch: float, charge: float, most: int):
    """(network, trees that it displays, mask of each site) of one alignment."""
    from ..kernels import network

    masks = {n: np.array([1 << "ACGT".find(c) if c in "ACGT" else 0 for c in s]) for n, s in zip(names, rows, strict=True)}
    tree, _ = topology.search_parsimony(topology.canonical(topology.nested(topology.nj_tree(names, rows))), masks)
    net, root, path, _total = network.search(tree, masks, switch, charge, most)
    return net, network.displays(net, root), path


def joint_network(sequences: DataFrame, switch: float = 4.0, charge: float = 4.0, most: int = 2) -> DataFrame:
    """dataset, event, start, end, displayed tree and network hash of each occurrence of a reticulation, from a parsimony network of the alignment."""
    from ..kernels import network

    def run(d, names, rows, _):
        net, shown, path = _network(names, rows, switch, charge, most)
        found = network.occurrences(path, len(network.reticulations(net)))
        out = pd.DataFrame({
            "event": np.array([b for b, _, _ in found], np.int32), "start": np.array([s for _, s, _ in found], np.int32), "end": np.array([e for _, _, e in found], np.int32),
            "newick": [topology.unit_newick(shown[int(path[s - 1])]) for _, s, _ in found], "network": [topology.network_hash(net)] * len(found),
        })
        return out.astype({"newick": object, "network": object})

    return _grouped(sequences, None, run, "event int, start int, end int, newick string, network string")


def network_regions(sequences: DataFrame, switch: float = 4.0, charge: float = 4.0, most: int = 2) -> DataFrame:
    """dataset, start, end, newick: the alignment covered by runs of one displayed tree of its parsimony network."""

    def run(d, names, rows, _):
        _net, shown, path = _network(names, rows, switch, charge, most)
        path = np.asarray(path)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
        return pd.DataFrame({"start": (edges[:-1] + 1).astype(np.int32), "end": edges[1:].astype(np.int32), "newick": [topology.unit_newick(shown[int(path[a])]) for a in edges[:-1]]})

    return _grouped(sequences, None, run, "start int, end int, newick string")


def stepwise_regions(sequences: DataFrame, least: int = 40, charge: float = 12.0, grid: int = 10) -> DataFrame:
    """dataset, start, end, newick: best-first partition by parsimony of a tree of each range's own, with cuts on a grid of sites."""
    from ..kernels import network

    def run(d, names, rows, _):
        blocks = len(rows[0]) // grid
        cut = lambda a, b: [s[(a - 1) * grid : (len(s) if b == blocks else b * grid)] for s in rows]

        def tree(a: int, b: int):
            return topology.canonical(topology.nested(topology.nj_tree(names, cut(a, b))))

        def cost(a: int, b: int) -> float:
            masks = {n: np.array([1 << "ACGT".find(c) if c in "ACGT" else 0 for c in s]) for n, s in zip(names, cut(a, b), strict=True)}
            return float(topology.fitch(tree(a, b), masks).sum())

        parts = network.stepwise(cost, blocks, max(1, least // grid), charge)
        ends = [len(rows[0]) if b == blocks else b * grid for _, b in parts]
        return pd.DataFrame({"start": np.array([(a - 1) * grid + 1 for a, _ in parts], np.int32), "end": np.array(ends, np.int32), "newick": [topology.unit_newick(tree(a, b)) for a, b in parts]})

    return _grouped(sequences, None, run, "start int, end int, newick string")
