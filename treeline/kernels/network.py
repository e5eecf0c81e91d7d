"""Joint networks: one rooted tree with reticulations whose switches, site by site, choose the displayed tree."""

from __future__ import annotations

import itertools

import numpy as np

from .hmm import mask_path
from .topology import Nested, canonical, display, fitch, network_hash, temporally_feasible

Network = dict[str, tuple[str, str | None]]  # node -> (parent, second parent of a reticulation)


def from_tree(tree: Nested) -> tuple[Network, str]:
    """(network without reticulations, root); inner nodes are named i0, i1, ..."""
    parents: Network = {}
    count = itertools.count()

    def walk(t: Nested) -> str:
        if isinstance(t, str):
            return t
        own = f"i{next(count)}"
        for child in t:
            parents[walk(child)] = (own, None)
        return own

    return parents, walk(canonical(tree))


def reticulations(net: Network) -> list[str]:
    return sorted(n for n, (_, second) in net.items() if second is not None)


def add(net: Network, child: str, target: str) -> Network | None:
    """A reticulation above ``child`` with a second parent on the branch above ``target``; None if it can't be."""
    if child == target or net[child][1] is not None or net[target][1] is not None or child.startswith("#") or target.startswith("#"):
        return None
    k = len(reticulations(net))
    new, reticulation, donor = dict(net), f"#r{k}", f"d{k}"
    new[donor] = net[target]
    new[target] = (donor, None)
    new[reticulation] = (net[child][0], donor)
    new[child] = (reticulation, None)
    return new if temporally_feasible(new) else None


def displays(net: Network, root: str) -> list[Nested]:
    own = reticulations(net)
    return [display(net, root, mask, own) for mask in range(1 << len(own))]


def score(net: Network, root: str, masks: dict[str, np.ndarray], switch: float, charge: float) -> tuple[float, np.ndarray]:
    """(parsimony of the best path over displays with priced switches and a charge for each reticulation, path)."""
    cost = np.stack([fitch(t, masks) for t in displays(net, root)], axis=1).astype(float)
    bits = len(reticulations(net))
    if not bits:
        return float(cost.sum()), np.zeros(len(cost), int)
    path, total = mask_path(cost, bits, np.full(bits, switch))
    return total + charge * bits, path


def search(tree: Nested, masks: dict[str, np.ndarray], switch: float = 4.0, charge: float = 4.0, most: int = 2, beam: int = 4) -> tuple[Network, str, np.ndarray, float]:
    """Beam search: each round adds one reticulation anywhere; it ends when no network gets cheaper."""
    net, root = from_tree(tree)
    best_total, path = score(net, root, masks, switch, charge)
    front, best = [(best_total, network_hash(net), net, path)], (best_total, net, path)
    for _ in range(most):
        step: dict[str, tuple] = {}
        for _, _, at, _ in front:
            for child, target in itertools.permutations(sorted(at), 2):
                new = add(at, child, target)
                if new is not None and (h := network_hash(new)) not in step:
                    total, own = score(new, root, masks, switch, charge)
                    step[h] = (total, h, new, own)
        front = sorted(step.values(), key=lambda x: x[:2])[:beam]
        if not front or front[0][0] >= best[0]:
            break
        best = (front[0][0], front[0][2], front[0][3])
    return best[1], root, best[2], best[0]


def occurrences(path: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bit, start, end) of each run of sites (1-based) in which a switch is set."""
    out = []
    for b in range(bits):
        on = np.concatenate([[0], (path >> b) & 1, [0]])
        step = np.diff(on)
        out += [(b, int(s) + 1, int(e)) for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
    return out


def stepwise(cost, sites: int, least: int, charge: float) -> list[tuple[int, int]]:
    """Best-first partition: cost(start, end) of an inclusive range is memoised; the split that saves most beyond the charge goes first."""
    known: dict[tuple[int, int], float] = {}

    def price(a: int, b: int) -> float:
        if (a, b) not in known:
            known[a, b] = float(cost(a, b))
        return known[a, b]

    def best(a: int, b: int) -> tuple[float, int] | None:
        cuts = range(a + least - 1, b - least + 1)
        found = min(((price(a, c) + price(c + 1, b) - price(a, b), c) for c in cuts), default=None)
        return found if found is not None and found[0] + charge < 0 else None

    parts = {(1, sites): best(1, sites)}
    while any(v is not None for v in parts.values()):
        (a, b), (_, c) = min(((k, v) for k, v in parts.items() if v is not None), key=lambda x: (x[1], x[0]))
        del parts[a, b]
        parts[a, c], parts[c + 1, b] = best(a, c), best(c + 1, b)
    return sorted(parts)
