"""Coalescent trees, recombination histories and codon evolution, with their truth."""

from __future__ import annotations

import numpy as np

from ..sources.parsers import Node
from .codon import BASES, CodonModel

#: Demographic presets: population size at a time back from the present, by name.
PRESETS = {
    "constant": lambda t: 1.0,
    "growth": lambda t: float(np.exp(-2.0 * t)),
    "decline": lambda t: float(np.exp(min(1.0 * t, 5.0))),
    "bottleneck": lambda t: 0.1 if 0.3 < t < 0.6 else 1.0,
    "expansion": lambda t: 1.0 if t < 0.2 else 0.2,
    "seasonal": lambda t: float(1.0 + 0.8 * np.sin(6.283185307 * t)),
    "logistic": lambda t: float(0.05 + 0.95 / (1 + np.exp(8 * (t - 0.5)))),
}


def coalescent(taxa: int, rng: np.random.Generator, preset: str = "constant", sampled: list[float] | None = None) -> Node:
    """A tree of taxa sampled at given times back (0 each unless given); names t0, t1, ..."""
    times = sorted((t, k) for k, t in enumerate(sampled or [0.0] * taxa))
    size, now = PRESETS[preset], 0.0
    live: list[tuple[Node, float]] = []
    while times or len(live) > 1:
        while times and (times[0][0] <= now or not live):
            t, k = times.pop(0)
            now = max(now, t)
            live.append((Node(f"t{k}"), t))
        if len(live) < 2:
            if not times:
                break
            now = times[0][0]
            continue
        pairs = len(live) * (len(live) - 1) / 2
        step = rng.exponential(max(size(now), 1e-3) / pairs)
        if times and now + step > times[0][0]:
            now = times[0][0]
            continue
        now += step
        i, j = sorted(rng.choice(len(live), 2, replace=False))
        (a, ta), (b, tb) = live[i], live[j]
        a.length, b.length = now - ta, now - tb
        live = [x for k, x in enumerate(live) if k not in (i, j)] + [(Node(children=[a, b]), now)]
    return live[0][0]


#: Population by equal steps of time, times the larger of tips and 10, and samples by equal steps, times tips over the horizon.
CURVES = {
    "constant": {"population": [5, 5], "sampling": [0, 0]},
    "serial": {"population": [5, 5], "sampling": [1, 1], "initial": 2},
    "exponential": {"population": [100, 35, 10, 2], "sampling": [0, 0]},
    "logistic": {"population": [80, 60, 12, 2, 1.2], "sampling": [1.2, 1.8, 0.75, 0.25], "initial": 3},
    "bottleneck": {"population": [15, 15, 0.2, 0.2, 12, 12], "sampling": [0, 0]},
}
#: The seasonal curves, whose population goes with the root of the tips.
SEASONAL = {"population": [12, 180, 16, 220, 14, 160, 12], "sampling": [0.15, 2.4, 0.2, 2.8, 0.2, 2.1, 0.15], "initial": 2}


def preset_curves(preset: str, horizon: float, tips: int) -> dict:
    """initial tips and (time, value) points of population size and sampling rate."""
    spec, scale = SEASONAL if preset == "seasonal" else CURVES[preset], max(10, tips)
    size = scale**0.5 if preset == "seasonal" else scale
    points = lambda v, factor: [(horizon * k / (len(v) - 1), x * factor) for k, x in enumerate(v)]
    return {"initial": min(tips, spec.get("initial", tips)), "population": points(spec["population"], size), "sampling": points(spec["sampling"], tips / horizon)}


def hazard(points: list[tuple[float, float]], horizon: float, bins: int = 4096, inverse: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(times, integral up to each, rate after the horizon) of a smooth curve through points; inverse: of 1 / value."""
    from .inference import pchip

    t, v = (np.array(x, float) for x in zip(*points, strict=True))
    at = np.linspace(0, horizon, bins + 1)
    log = bool((v > 0).all())
    y = pchip(t, np.log(v) if log else v, np.clip(at, t[0], t[-1]))
    rate = np.exp(y) if log else np.maximum(y, 0.0)
    rate = 1 / np.maximum(rate, 1e-12) if inverse else rate
    return at, np.concatenate([[0.0], np.cumsum((rate[1:] + rate[:-1]) / 2) * horizon / bins]), float(rate[-1])


def next_event(now: float, pairs: float, coalescent_hazard, sampling_hazard, rng: np.random.Generator) -> tuple[float, bool]:
    """(time, whether it is a coalescence) of the first of two competing events: the summed integral is inverted, with constant rates after its end."""
    times, c, tail_c = coalescent_hazard
    _, s, tail_s = sampling_hazard or (times, np.zeros_like(c), 0.0)
    total, tail = pairs * c + s, pairs * tail_c + tail_s
    start = np.interp(now, times, total) + max(0.0, now - times[-1]) * tail
    target = start + rng.exponential()
    if target > total[-1]:
        if tail <= 0:
            return float("inf"), True
        when = times[-1] + (target - total[-1]) / tail
        return float(when), bool(rng.random() * tail < pairs * tail_c)
    when = float(np.interp(target, total, times))
    k = min(int(np.searchsorted(times, when, "right")), len(times) - 1)
    rate_c, rate_s = pairs * (c[k] - c[k - 1]), s[k] - s[k - 1]
    return when, bool(rng.random() * (rate_c + rate_s) < rate_c)


def coalescent_curves(tips: int, rng: np.random.Generator, curves: dict, horizon: float, ploidy: int = 1, bins: int = 4096) -> Node:
    """A tree of tips under curves of population and sampling: some at time 0, the rest sampled back in time; the last waits for none."""
    merge, draw = hazard(curves["population"], horizon, bins, True), hazard(curves["sampling"], horizon, bins)
    merge = merge[0], merge[1] / ploidy, merge[2] / ploidy
    live = [(Node(f"t{k}"), 0.0) for k in range(curves["initial"])]
    now, sampled = 0.0, len(live)
    while len(live) > 1 or sampled < tips:
        when, joins = next_event(now, len(live) * (len(live) - 1) / 2, merge, draw if sampled < tips else None, rng)
        if when == float("inf"):  # nothing can happen before the next sample, and none is drawn: take it now
            when, joins = max(now, horizon), False
        now = when
        if not joins:
            live.append((Node(f"t{sampled}"), now))
            sampled += 1
            continue
        i, j = sorted(rng.choice(len(live), 2, replace=False))
        (a, ta), (b, tb) = live[i], live[j]
        a.length, b.length = now - ta, now - tb
        live = [x for k, x in enumerate(live) if k not in (i, j)] + [(Node(children=[a, b]), now)]
    return live[0][0]


def hotspot_weights(sites: int, centres: list[tuple[float, float, float]]) -> np.ndarray:
    """1 plus Gaussians (centre, intensity, width) at each boundary."""
    x = np.arange(1, sites)
    return 1 + sum((i * np.exp(-0.5 * ((x - c) / w) ** 2) for c, i, w in centres), np.zeros(sites - 1))


def distinct_breakpoints(n: int, weights: np.ndarray, rng: np.random.Generator) -> list[int]:
    """Boundaries after which a break lies, without repeats."""
    n = min(n, int((weights > 0).sum()))
    return sorted(int(v) + 1 for v in rng.choice(len(weights), n, replace=False, p=weights / weights.sum()))


def history(tree, codons: int, events: int, rng: np.random.Generator, weights: np.ndarray | None = None) -> list[tuple[int, int, object]]:
    """(start, end, nested tree) of each region: every breakpoint changes the tree by one random SPR move."""
    from .topology import canonical, spr_moves

    breaks = distinct_breakpoints(events, np.ones(codons - 1) if weights is None else weights, rng)
    at, out, start = canonical(tree), [], 1
    for b in [*breaks, codons]:
        out.append((start, b, at))
        start = b + 1
        if b < codons:
            moves = [t for _, _, t in spr_moves(at)]
            at = moves[int(rng.integers(len(moves)))] if moves else at
    return out


def evolve(root: Node, model: CodonModel, alpha: float, beta: float, rng: np.random.Generator) -> dict[str, str]:
    """One codon site along a tree, jump by jump."""
    q = model.generator(alpha, beta)
    rates = -np.diag(q)
    jump = np.where(np.eye(len(q), dtype=bool), 0, q) / np.maximum(rates, 1e-300)[:, None]
    cum = np.cumsum(jump, axis=1)
    out, todo = {}, [(root, int(rng.choice(len(model.pi), p=model.pi)))]
    while todo:
        node, state = todo.pop()
        t = node.length or 0.0 if node is not root else 0.0
        while rates[state] > 0:
            t -= rng.exponential(1 / rates[state])
            if t < 0:
                break
            state = int(min(np.searchsorted(cum[state], rng.random() * cum[state, -1]), len(q) - 1))
        if node.children:
            todo += [(c, state) for c in node.children]
        else:
            out[node.name] = model.codons[state]
    return out


def fitness_site(model: CodonModel, sigma: float, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """(expected ratio of rates, fitness of each state): a site with normal fitness of its amino acids."""
    from ..functions.codes import genetic_code

    code = genetic_code()
    of = {aa: rng.normal(0, sigma) for aa in sorted(set(code.values()) - {"*"})}
    f = np.array([of[code[c]] for c in model.codons])
    return float(np.sqrt(sigma**2 + np.pi) / np.sqrt(np.pi)), f


def refresh_fitness(f: np.ndarray, age: float, scale: float, sigma: float, rng: np.random.Generator) -> np.ndarray:
    """AR(1) renewal with correlation exp(-age / scale)."""
    rho = np.exp(-age / scale)
    return rho * f + np.sqrt(1 - rho * rho) * rng.normal(0, sigma, len(f))


def expected_ratio(model: CodonModel, f: np.ndarray) -> float:
    """Selected over neutral flux of nonsynonymous changes at equilibrium, against synonymous ones."""
    d = f[None, :] - f[:, None]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        fix = np.where(np.abs(d) < 1e-6, 1 + d / 2, d / -np.expm1(-d))
    pi = model.pi * np.exp(f - f.max())
    pi /= pi.sum()
    n = (pi[:, None] * model.non * fix).sum() / (pi[:, None] * model.non).sum()
    s = (pi[:, None] * model.syn * fix).sum() / (pi[:, None] * model.syn).sum()
    return float(n / s)


def dataset(seed: int, taxa: int = 8, codons: int = 100, scale: float = 0.3, share_positive: float = 0.1, events: int = 0, preset: str = "constant") -> dict:
    """names, sequences, newick, truth (site, alpha, omega) and regions of one replicate."""
    from .topology import nested, to_node

    rng = np.random.default_rng(seed)
    tree = coalescent(taxa, rng, preset)
    todo, total = [tree], 0.0
    while todo:
        node = todo.pop()
        total += node.length or 0.0
        todo += node.children
    factor = scale * (2 * taxa - 2) / max(total, 1e-9) / 3
    todo = [tree]
    while todo:
        node = todo.pop()
        node.length = (node.length or 0.0) * factor
        todo += node.children
    model = CodonModel(np.ones(6), np.full((3, 4), 0.25))
    regions = history(nested(tree), codons, events, rng) if events else [(1, codons, None)]
    columns, truth = [], []
    for start, end, local in regions:
        use = tree if local is None else to_node(local, scale / 3)
        for site in range(start, end + 1):
            alpha = float(rng.gamma(2.0, 0.5))
            omega = float(rng.uniform(2, 5)) if rng.random() < share_positive else float(rng.beta(1, 4))
            columns.append(evolve(use, model, alpha, alpha * omega, rng))
            truth.append((site, alpha, omega))
    names = [f"t{k}" for k in range(taxa)]
    from ..sources.parsers import write_newick
    from .topology import unit_newick

    return {
        "names": names, "sequences": ["".join(c[n] for c in columns) for n in names], "newick": write_newick(tree), "truth": truth,
        "regions": [(a, b, "" if t is None else unit_newick(t)) for a, b, t in regions],
    }


def random_bases(n: int, rng: np.random.Generator) -> str:
    return "".join(BASES[k] for k in rng.integers(0, 4, n))


def replicate_seed(seed: int, replicate: int) -> int:
    return ((seed ^ (replicate * 2654435761)) & 0xFFFFFFFF) * 2246822519 & 0xFFFFFFFF
