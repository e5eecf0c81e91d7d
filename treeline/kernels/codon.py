"""Codon and nucleotide models: rate matrices, transition matrices, pruning, and site likelihoods over grids."""

from __future__ import annotations

import numpy as np

from ..functions.codes import genetic_code, sense_codons
from ..sources.parsers import Node

BASES = "ACGT"


def gtr_matrix(rates: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Generator from six exchangeabilities (AC, AG, AT, CG, CT, GT), scaled to one substitution per unit of time."""
    q = np.zeros((4, 4))
    for (i, j), r in zip([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)], rates, strict=True):
        q[i, j], q[j, i] = r * pi[j], r * pi[i]
    np.fill_diagonal(q, -q.sum(1))
    return q / -(pi @ np.diag(q))


class Reversible:
    """Eigensystem of a reversible generator by its symmetric form; P(t) for any t."""

    def __init__(self, q: np.ndarray, pi: np.ndarray):
        root = np.sqrt(np.maximum(pi, 1e-300))
        s = q * root[:, None] / root[None, :]
        self.values, u = np.linalg.eigh((s + s.T) / 2)
        self.left, self.right = u / root[:, None], u.T * root[None, :]

    def p(self, t: float) -> np.ndarray:
        return np.maximum(self.left * np.exp(self.values * t) @ self.right, 0)

    def dp(self, t: float) -> np.ndarray:
        return self.left * (self.values * np.exp(self.values * t)) @ self.right


def uniformised(q: np.ndarray, t: float, v: np.ndarray, tail: float = 1e-14, most: float = 64.0) -> np.ndarray:
    """exp(q t) v as a Poisson mixture of powers, in steps of at most ``most`` expected jumps."""
    rate = float(-np.diag(q).min())
    if rate * t == 0:
        return v.copy()
    steps = max(1, int(np.ceil(rate * t / most)))
    lam = rate * t / steps
    jump = np.eye(len(q)) + q / rate
    for _ in range(steps):
        weight = np.exp(-lam)
        term, out, have, k = v, weight * v, weight, 0
        while 1 - have > tail and k < 1000:
            k += 1
            term = jump @ term
            weight *= lam / k
            out = out + weight * term
            have += weight
        v = out
    return v


class CodonModel:
    """MG94 x GTR over the sense codons of a genetic code: rate alpha for synonymous and beta for other changes."""

    def __init__(self, rates: np.ndarray, f3x4: np.ndarray, table: int = 1):
        self.codons = sense_codons(table)
        self.state = {c: k for k, c in enumerate(self.codons)}
        code, n = genetic_code(table), len(self.codons)
        pi = np.array([np.prod([f3x4[p, BASES.index(c[p])] for p in range(3)]) for c in self.codons])
        self.pi = pi / pi.sum()
        r = np.ones((4, 4))
        for (i, j), v in zip([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)], rates, strict=True):
            r[i, j] = r[j, i] = v
        self.syn, self.non = np.zeros((n, n)), np.zeros((n, n))
        for i, a in enumerate(self.codons):
            for j, b in enumerate(self.codons):
                at = [p for p in range(3) if a[p] != b[p]]
                if len(at) == 1:
                    x, y = BASES.index(a[at[0]]), BASES.index(b[at[0]])
                    (self.syn if code[a] == code[b] else self.non)[i, j] = r[x, y] * f3x4[at[0], y]
        self.scale = float(self.pi @ (self.syn + self.non).sum(1))
        self._known: dict[tuple[float, float], Reversible] = {}

    def generator(self, alpha: float, beta: float) -> np.ndarray:
        q = (alpha * self.syn + beta * self.non) / self.scale
        np.fill_diagonal(q, -q.sum(1))
        return q

    def transition(self, alpha: float, beta: float, t: float) -> np.ndarray:
        key = (alpha, beta)
        if key not in self._known:
            self._known[key] = Reversible(self.generator(alpha, beta), self.pi)
        return self._known[key].p(t)

    def states(self, sequence: str) -> np.ndarray:
        """State of each codon, -1 where it is missing, a stop or ambiguous."""
        return np.array([self.state.get(sequence[k : k + 3], -1) for k in range(0, len(sequence) - 2, 3)])


class Tree:
    """Postorder arrays of a parsed tree."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.parent: list[int] = []
        order, todo = [], [(root, -1)]
        while todo:
            node, parent = todo.pop()
            k = len(order)
            order.append((node, parent))
            todo += [(c, k) for c in reversed(node.children)]
        n = len(order)
        self.nodes = [node for node, _ in order]
        self.parent = [p for _, p in order]
        self.children: list[list[int]] = [[] for _ in range(n)]
        for k, p in enumerate(self.parent):
            if p >= 0:
                self.children[p].append(k)
        self.tips = [k for k in range(n) if not self.children[k]]
        self.length = np.array([node.length or 0.0 for node in self.nodes])
        self.post = list(range(n - 1, -1, -1))  # preorder reversed: children before parents


def tip_vectors(states: np.ndarray, n: int) -> np.ndarray:
    """[state, site] indicator columns; a missing state allows all."""
    v = np.zeros((n, len(states)))
    known = states >= 0
    v[states[known], np.flatnonzero(known)] = 1
    v[:, ~known] = 1
    return v


def prune(tree: Tree, tips: dict[int, np.ndarray], transition, pi: np.ndarray) -> np.ndarray:
    """Log likelihood of each site. tips: node -> [state, site]; transition(node) -> matrix of its branch."""
    sites = next(iter(tips.values())).shape[1]
    partial: dict[int, np.ndarray] = {}
    log = np.zeros(sites)
    for k in tree.post:
        if tree.children[k]:
            v = np.ones((len(pi), sites))
            for c in tree.children[k]:
                v *= transition(c) @ partial.pop(c)
            top = np.maximum(v.max(0), 1e-300)
            log += np.log(top)
            partial[k] = v / top
        else:
            partial[k] = tips[k]
    return log + np.log(np.maximum(pi @ partial[0], 1e-300))


def messages(tree: Tree, tips: dict[int, np.ndarray], transition, pi: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], np.ndarray]:
    """(down, up, log likelihood): below each node, and above each branch at its parent's end, without the branch itself.

    The site likelihood with branch k replaced by P is pi-free: sum over states of up[k] * (P @ down[k]).
    """
    down: dict[int, np.ndarray] = {}
    sent: dict[int, np.ndarray] = {}
    for k in tree.post:
        v = tips[k].copy() if not tree.children[k] else np.ones((len(pi), next(iter(tips.values())).shape[1]))
        for c in tree.children[k]:
            sent[c] = transition(c) @ down[c]
            v *= sent[c]
        down[k] = v
    up: dict[int, np.ndarray] = {}
    for k in reversed(tree.post):
        at = pi[:, None] * np.ones_like(down[k]) if k == 0 else transition(k).T @ up[k]
        for c in tree.children[k]:
            v = at.copy()
            for d in tree.children[k]:
                if d != c:
                    v *= sent[d]
            up[c] = v
    return down, up, np.log(np.maximum(pi @ down[0], 1e-300))


def compress(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different columns, which of them each column is)."""
    different, at = np.unique(columns, axis=1, return_inverse=True)
    return different, at.ravel()


class Operators:
    """Transition matrices of many (alpha, beta) at once, from one stacked eigensystem."""

    def __init__(self, model: CodonModel, alphas: np.ndarray, betas: np.ndarray):
        a, b = np.asarray(alphas, float), np.asarray(betas, float)
        root = np.sqrt(np.maximum(model.pi, 1e-300))
        syn, non = (m * root[:, None] / root[None, :] / model.scale for m in (model.syn, model.non))
        q = a[:, None, None] * (syn + syn.T) / 2 + b[:, None, None] * (non + non.T) / 2
        diagonal = np.arange(len(model.pi))
        q[:, diagonal, diagonal] = -(a[:, None] * model.syn.sum(1) + b[:, None] * model.non.sum(1)) / model.scale
        self.values, u = np.linalg.eigh(q)
        self.left, self.right = u / root[:, None], u.transpose(0, 2, 1) * root
        self.known: dict[float, np.ndarray] = {}

    def p(self, t: float) -> np.ndarray:
        """[category, state, state], remembered for each length."""
        if t not in self.known:
            self.known[t] = np.maximum((self.left * np.exp(self.values * t)[:, None, :]) @ self.right, 0)
        return self.known[t]


def _tip_columns(p: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Operators [..., state, state] at the states of a tip; a missing state allows all."""
    sent = p[..., np.maximum(states, 0)]
    sent[..., states < 0] = 1.0
    return sent


def stacked_likelihood(tree: Tree, pi: np.ndarray, columns: np.ndarray, operator) -> np.ndarray:
    """[..., column] log likelihoods. operator(node) -> [..., state, state]; leading axes of different branches broadcast, so
    what a subtree doesn't depend on is computed once."""
    row = {k: i for i, k in enumerate(tree.tips)}
    partial: dict[int, np.ndarray] = {}
    log = np.zeros(columns.shape[1])
    for k in tree.post:
        if tree.children[k]:
            v = None
            for c in tree.children[k]:
                p = operator(c)
                sent = _tip_columns(p, columns[row[c]]) if c in row else p @ partial.pop(c)
                v = sent if v is None else v * sent
            top = np.maximum(v.max(-2, keepdims=True), 1e-300)
            log = log + np.log(top[..., 0, :])
            partial[k] = v / top
    return log + np.log(np.maximum(np.einsum("s,...st->...t", pi, partial[0]), 1e-300))


def grid_likelihood(tree: Tree, model: CodonModel, states: np.ndarray, alphas: np.ndarray, betas: np.ndarray, block: int = 96, banks: dict[int, Operators] | None = None) -> np.ndarray:
    """[category, site] log likelihoods; states are [tip, site] in order of tree.tips. Equal columns are computed once.

    banks: eigensystems and transitions that calls with the same model, grid and tree share; filled by the first.

    Categories are batched: one stacked eigensystem for a block, one stacked product for a branch, and
    tips read the columns of their states instead of multiplying.
    """
    columns, at = compress(states)
    out = np.empty((len(alphas), columns.shape[1]))
    for lo in range(0, len(alphas), block):
        bank = banks.get(lo) if banks is not None else None
        if bank is None:
            bank = Operators(model, alphas[lo : lo + block], betas[lo : lo + block])
            if banks is not None:
                banks[lo] = bank
        out[lo : lo + block] = stacked_likelihood(tree, model.pi, columns, lambda k: bank.p(float(tree.length[k])))  # noqa: B023
    return out[:, at]


def class_grid_likelihood(tree: Tree, model: CodonModel, states: np.ndarray, group: list[int], alpha: float, omegas: list[list[float]], block: int = 64) -> np.ndarray:
    """[ratio of group 0, ratio of group 1, ..., site] log likelihoods for one alpha, branch k having a ratio of group[k]'s list."""
    columns, at = compress(states)
    banks = [Operators(model, np.full(len(w), alpha), alpha * np.asarray(w, float)) for w in omegas]

    def operator(k: int) -> np.ndarray:
        p = banks[group[k]].p(float(tree.length[k]))
        return p.reshape([len(p) if g == group[k] else 1 for g in range(len(omegas))] + list(p.shape[1:]))

    parts = [stacked_likelihood(tree, model.pi, columns[:, lo : lo + block], operator) for lo in range(0, columns.shape[1], block)]
    shape = tuple(map(len, omegas))
    return np.concatenate([np.broadcast_to(x, (*shape, x.shape[-1])) for x in parts], axis=-1)[..., at]


def slice_mixture_likelihood(tree: Tree, model: CodonModel, states: np.ndarray, alphas: list[float], mixtures: list[np.ndarray], block: int = 64) -> np.ndarray:
    """[mixture, alpha, site] log likelihoods if each branch is the mean of the operators of a mixture's equally likely ratios.

    alpha stretches time, so all alphas share one eigensystem for each ratio.
    """
    columns, at = compress(states)
    rates = np.unique(np.concatenate(mixtures))
    bank = Operators(model, np.ones(len(rates)), rates)
    weight = np.stack([np.bincount(np.searchsorted(rates, m), minlength=len(rates)) / len(m) for m in mixtures])
    out = np.empty((len(mixtures), len(alphas), columns.shape[1]))
    for i, alpha in enumerate(alphas):
        known: dict[float, np.ndarray] = {}

        def operator(k: int) -> np.ndarray:
            t = float(tree.length[k]) * alpha  # noqa: B023
            if t not in known:  # noqa: B023
                p = bank.p(t)
                bank.known.clear()
                known[t] = (weight @ p.reshape(len(p), -1)).reshape(len(mixtures), *p.shape[1:])  # noqa: B023
            return known[t]  # noqa: B023

        for lo in range(0, columns.shape[1], block):
            out[:, i, lo : lo + block] = stacked_likelihood(tree, model.pi, columns[:, lo : lo + block], operator)
    return out[:, :, at]


def mixture_likelihood(tree: Tree, model: CodonModel, states: np.ndarray, mixture: list[tuple[float, float, float]]) -> np.ndarray:
    """Site log likelihoods if each branch is a mixture of (weight, alpha, beta) operators."""
    columns, at = compress(states)
    tips = {k: tip_vectors(columns[i], len(model.pi)) for i, k in enumerate(tree.tips)}
    known: dict[float, np.ndarray] = {}

    def transition(k: int) -> np.ndarray:
        t = float(tree.length[k])
        if t not in known:
            known[t] = sum(w * model.transition(a, b, t) for w, a, b in mixture)
        return known[t]

    return prune(tree, tips, transition, model.pi)[at]


def empirical_gtr(sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(six exchangeabilities with geometric mean 1, base frequencies) from shared sites."""
    matrix = np.array([[BASES.find(c) for c in s] for s in sequences])
    counts = np.stack([(matrix == k).sum(0) for k in range(4)]).astype(float)
    total = counts.sum(1) + 1.0
    pi = total / total.sum()
    raw = np.array([((counts[i] * counts[j]).sum() + 0.5) / (pi[i] * pi[j]) for i in range(4) for j in range(i + 1, 4)])
    return raw / np.exp(np.log(raw).mean()), pi


def f3x4(sequences: list[str]) -> np.ndarray:
    """[position, base] frequencies; codons with missing letters stay in the denominator, then rows are scaled to 1."""
    f = np.zeros((3, 4))
    for s in sequences:
        for k, c in enumerate(s):
            if c in BASES:
                f[k % 3, BASES.index(c)] += 1
    f = np.maximum(f, 0.5)
    return f / f.sum(1, keepdims=True)
