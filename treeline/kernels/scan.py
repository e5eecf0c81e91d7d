"""Hidden Markov chains by blocks of sites: folding blocks to one matrix each, and decoding them between what comes before and after.

Site t has the matrix A_t[i, j] = transition[i, j] + emission[t, j]; a block's matrix is the product of
its sites' in the (+, x) or the (max, +) semiring, both kept as logarithms. The first site of a chain has
A[i, j] = initial[j] + emission[j], so a chain starts from the vector (0, -inf, ...).

Many blocks of one chain model are stepped side by side: arrays are [site, block, state], the longest
block first, so that those which still have a site are the first ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Step = Callable[[np.ndarray, np.ndarray], np.ndarray]


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the matrix products exp(a) exp(b), each scaled by its largest entries."""
    top_a, top_b = a.max(-1, keepdims=True), b.max(-2, keepdims=True)
    top_a, top_b = np.where(np.isfinite(top_a), top_a, 0), np.where(np.isfinite(top_b), top_b, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top_a) @ np.exp(b - top_b)) + top_a + top_b


def most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) products."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def fold(a: np.ndarray, product) -> np.ndarray:
    """The product of all matrices of [n, ..., k, k], by halves."""
    while len(a) > 1:
        odd = a[len(a) - len(a) % 2 :]
        a = np.concatenate([product(a[0 : len(a) - len(odd) : 2], a[1 : len(a) - len(odd) : 2]), odd])
    return a[0]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def sum_step(at: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Vectors [..., k] moved on by one transition, over all paths."""
    return log_sum(at[..., :, None] + transition, -2)


def best_step(at: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Vectors [..., k] moved on by one transition, by the best path."""
    out = at[..., 0, None] + transition[0]
    for i in range(1, len(transition)):
        np.maximum(out, at[..., i, None] + transition[i], out=out)
    return out


def enter(blocks: int, k: int) -> np.ndarray:
    """What chains start from."""
    v = np.full((blocks, k), -np.inf)
    v[:, 0] = 0
    return v


class Side:
    """Where the rows of blocks lie side by side. counts: rows of each block, none rising."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.n = counts, int(counts.max(initial=0))
        self.block = np.repeat(np.arange(len(counts)), counts)
        self.at = np.arange(len(self.block)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.active = len(counts) - np.searchsorted(counts[::-1], np.arange(self.n), "right")

    def lay(self, flat: np.ndarray, fill: float | np.ndarray) -> np.ndarray:
        """[row, ...] of one block after the other as [row of its block, block, ...]."""
        out = np.empty((self.n, len(self.counts), *flat.shape[1:]), flat.dtype)
        out[...] = fill
        out[self.at, self.block] = flat
        return out

    def flat(self, laid: np.ndarray) -> np.ndarray:
        return laid[self.at, self.block]


def fold_blocks(side: Side, emission: np.ndarray, initial: np.ndarray, transition: np.ndarray, first: np.ndarray, step: Step) -> np.ndarray:
    """The matrices [block, k, k]; ``first`` marks blocks in which a chain begins."""
    a = np.where(first[:, None, None], initial, transition) + emission[0][:, None, :]
    for t in range(1, side.n):
        m = side.active[t]
        a[:m] = step(a[:m], transition) + emission[t, :m, None, :]
    return a


def forward(side: Side, emission: np.ndarray, initial: np.ndarray, transition: np.ndarray, first: np.ndarray, before: np.ndarray, step: Step) -> tuple[np.ndarray, np.ndarray]:
    """(before each site, at each site) of blocks entered with ``before``."""
    prior, upto, at = np.empty_like(emission), np.empty_like(emission), before.copy()
    for t in range(side.n):
        m = side.active[t]
        prior[t, :m] = at[:m]
        moved = step(at[:m], transition)
        if t == 0:
            moved = np.where(first[:, None], initial, moved)
        at[:m] = moved + emission[t, :m]
        upto[t, :m] = at[:m]
    return prior, upto


def backward(side: Side, emission: np.ndarray, transition: np.ndarray, after: np.ndarray, step: Step) -> np.ndarray:
    """What follows each site, of blocks left for ``after``."""
    rest, at, back = np.empty_like(emission), after.copy(), transition.T
    for t in range(side.n - 1, -1, -1):
        m = side.active[t]
        rest[t, :m] = at[:m]
        at[:m] = step(emission[t, :m] + at[:m], back)
    return rest


def best_steps(side: Side, emission: np.ndarray, initial: np.ndarray, transition: np.ndarray, first: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state before each site for each state at it; best state at each block's end) of best paths that enter with ``before``; the first of equals."""
    back, at = np.zeros(emission.shape, np.int32), before.copy()
    for t in range(side.n):
        m = side.active[t]
        best, arg = at[:m, 0, None] + transition[0], back[t, :m]
        for i in range(1, len(transition)):
            other = at[:m, i, None] + transition[i]
            np.copyto(arg, i, where=other > best)
            np.maximum(best, other, out=best)
        if t == 0:
            best = np.where(first[:, None], initial, best)
            arg[first] = 0
        at[:m] = best + emission[t, :m]
    return back, at.argmax(1)


def entrance(side: Side, back: np.ndarray) -> np.ndarray:
    """The state before each block for each state at its end."""
    at = np.tile(np.arange(back.shape[2]), (back.shape[1], 1))
    for t in range(side.n - 1, -1, -1):
        m = side.active[t]
        at[:m] = np.take_along_axis(back[t, :m], at[:m], 1)
    return at


def trace(side: Side, back: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[site, block]: the states of the paths that end in ``end``."""
    path, at = np.zeros(back.shape[:2], np.int32), end.copy()
    for t in range(side.n - 1, -1, -1):
        m = side.active[t]
        path[t, :m] = at[:m]
        at[:m] = back[t, np.arange(m), at[:m]]
    return path


def best_intervals(side: Side, own: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, ...]:
    """What blocks add to the least cost of one interval: (total, low, high, within), each [block, candidate].

    own: cost of each candidate at each site; enter, leave: of an interval that starts, or has ended, just before
    the site. low is the least cost of starts less what of the block lies before them; high of ends, with what
    lies before them; within of intervals that start and end here, which are never empty.
    """
    shape = own.shape[1:]
    total, low, high, within = np.zeros(shape), np.full(shape, np.inf), np.full(shape, np.inf), np.full(shape, np.inf)
    for t in range(side.n):
        m = side.active[t]
        end = leave[t, :m] + total[:m]
        np.minimum(within[:m], end + low[:m], out=within[:m])
        np.minimum(high[:m], end, out=high[:m])
        np.minimum(low[:m], enter[t, :m] - total[:m], out=low[:m])
        total[:m] += own[t, :m]
    return total, low, high, within
