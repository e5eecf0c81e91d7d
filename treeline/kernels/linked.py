"""Several trees that share branch lengths: each branch is a sum of atomic lengths, fitted together."""

from __future__ import annotations

import numpy as np

from .codon import Reversible, Tree, compress, messages, tip_vectors
from .inference import lbfgs


class LinkedTrees:
    """Regional trees with [tip, site] states each; atoms[t][node] lists the atomic edges of that branch (the root's is empty)."""

    def __init__(self, trees: list[Tree], states: list[np.ndarray], atoms: list[list[list[int]]], system: Reversible, pi: np.ndarray, least: float = 1e-6):
        self.trees, self.atoms, self.system, self.pi, self.least = trees, atoms, system, pi, least
        self.n = 1 + max(a for tree in atoms for node in tree for a in node)
        self.data = []
        for tree, s in zip(trees, states, strict=True):
            columns, at = compress(s)
            self.data.append(({k: tip_vectors(columns[i], len(pi)) for i, k in enumerate(tree.tips)}, np.bincount(at, minlength=columns.shape[1])))

    def evaluate(self, lengths: np.ndarray) -> tuple[float, np.ndarray]:
        """(log likelihood, gradient) by atomic lengths, from one up and one down pass of each tree."""
        total, gradient = 0.0, np.zeros(self.n)
        for tree, atoms, (tips, weight) in zip(self.trees, self.atoms, self.data, strict=True):
            t = [sum(lengths[a] for a in own) for own in atoms]
            p = {k: self.system.p(max(t[k], self.least)) for k in range(1, len(tree.nodes))}
            down, up, logl = messages(tree, tips, p.__getitem__, self.pi)
            total += float(weight @ logl)
            site = np.exp(logl)
            for k in range(1, len(tree.nodes)):
                slope = float(weight @ ((up[k] * (self.system.dp(max(t[k], self.least)) @ down[k])).sum(0) / site))
                gradient[atoms[k]] += slope
        return total, gradient

    def fit(self, start: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
        """Lengths by quasi-Newton on their logarithms."""
        f = lambda x: self.evaluate(np.exp(np.clip(x, -14, 4)))[0]
        g = lambda x: self.evaluate(np.exp(np.clip(x, -14, 4)))[1] * np.exp(np.clip(x, -14, 4))
        x, value = lbfgs(f, np.log(np.maximum(start, self.least)), steps, gradient=g)
        return np.exp(np.clip(x, -14, 4)), value


class TransitionTable:
    """P(t) of a mixture of generators on evenly spaced times, interpolated; beyond the last node it is the equilibrium."""

    def __init__(self, parts: list[tuple[float, Reversible]], pi: np.ndarray, longest: float = 4.0, nodes: int = 50):
        self.step, self.longest = longest / (nodes - 1), longest
        small = [(w, s.p(self.step)) for w, s in parts]
        powers = [np.eye(len(pi)) for _ in parts]
        self.table = [sum(w * m for (w, _), m in zip(parts, powers, strict=True))]
        for _ in range(nodes - 2):  # P(t + h) = P(t) P(h)
            powers = [m @ p for m, (_, p) in zip(powers, small, strict=True)]
            self.table.append(sum(w * m for (w, _), m in zip(parts, powers, strict=True)))
        self.table.append(np.tile(pi, (len(pi), 1)))

    def p(self, t: float) -> np.ndarray:
        x = min(t, self.longest) / self.step
        k = min(int(x), len(self.table) - 2)
        return self.table[k] + (x - k) * (self.table[k + 1] - self.table[k])
