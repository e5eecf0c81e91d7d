"""Alignment of pairs of long texts by seeds: k-mers that are unique in both, their longest rising chain, and affine fills between."""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..kernels.align import near_text

#: Fixed value of the hash of seeds, odd.
_MIX = 0x9E3779B97F4A7C15


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def seeds(text: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-mers of a text, by place."""
    n = len(text) - k + 1
    # hashes of 1, 2, 4, ... letters; those that k is the sum of, one after the other
    part, step, out, done, width = text + np.uint64(1), _MIX, np.zeros(max(n, 0), np.uint64), 0, 1
    while n > 0 and done < k:
        if k & width:
            out = out * np.uint64(step) + part[done : done + n]
            done += width
        part, step, width = part[:-width] * np.uint64(step) + part[width:], step * step % (1 << 64), 2 * width
    return out


def seed_chain(a: str, b: str, k: int) -> np.ndarray:
    """[anchor, 2]: the longest rising chain of the k-mers that are unique in both texts, whose letters are compared."""
    one, two = seeds(letters(a), k), seeds(letters(b), k)
    both = np.concatenate([one, two])
    order = np.argsort(both)
    both = both[order]
    new = np.ones(len(both) + 1, bool)
    np.not_equal(both[1:], both[:-1], out=new[1:-1])
    pair = np.flatnonzero(new[:-2] & ~new[1:-1] & new[2:])
    x, y = order[pair], order[pair + 1]
    x, y = np.minimum(x, y), np.maximum(x, y) - len(one)
    shared = (x < len(one)) & (y >= 0)
    to = np.full(len(one), -1)
    to[x[shared]] = y[shared]
    at = np.flatnonzero(to >= 0)
    anchors = np.stack([at, to[at]], 1)
    while True:
        rises = (anchors[1:, 1] > anchors[:-1, 1]).all()
        chain = anchors if rises else np.array(rising([tuple(x) for x in anchors.tolist()]), np.int64).reshape(-1, 2)
        if all(a[p : p + n] == b[q : q + n] for p, q, n in runs(chain, k)):
            return chain
        anchors = np.array([[p, q] for p, q in anchors.tolist() if a[p : p + k] == b[q : q + k]], np.int64).reshape(-1, 2)


def rising(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (place in one, place in the other) that rises in both; the first found of equals."""
    tails, at, back = [], [], []
    anchors = sorted(anchors)
    for n, (_, j) in enumerate(anchors):
        p = bisect.bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        tails[p : p + 1], at[p : p + 1] = [j], [n]
    chain, n = [], at[-1] if at else -1
    while n >= 0:
        chain.append(anchors[n])
        n = back[n]
    return chain[::-1]


#: Cells of one affine alignment, which bounds a task's memory; a larger stretch is seeded again.
CELLS, LEAST_K = 1 << 21, 6
#: Letters of a pair of stretches that is remembered; letters of a frame of results.
SHORT, FRAME = 48, 1 << 23

short_text = functools.lru_cache(1 << 15)(near_text)


def ordinal(a: str, b: str, k: int) -> list[tuple[int, int]]:
    """Places of k-mers that two stretches have equally often, paired in their order."""

    def places(s: str) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i in range(len(s) - k + 1):
            out.setdefault(s[i : i + k], []).append(i)
        return out

    x, y = places(a), places(b)
    return [pair for w in x.keys() & y.keys() if len(x[w]) == len(y[w]) for pair in zip(x[w], y[w], strict=True)]


def fill(a: str, b: str, k: int) -> tuple[str, str]:
    """Two stretches with gaps. Those of more than ``CELLS`` cells lose their equal ends and are seeded by shorter k-mers; if none is left, both are halved."""
    if not a or not b:
        return a + "-" * len(b), "-" * len(a) + b
    if len(a) * len(b) <= CELLS:
        return (short_text if len(a) + len(b) <= SHORT else near_text)(a, b)
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    m = next((i for i, (x, y) in enumerate(zip(a[n:][::-1], b[n:][::-1], strict=False)) if x != y), min(len(a), len(b)) - n)
    if n or m:
        left, right = fill(a[n : len(a) - m], b[n : len(b) - m], k)
        return a[:n] + left + a[len(a) - m :], b[:n] + right + b[len(b) - m :]
    while k >= LEAST_K:
        chain = rising(ordinal(a, b, k))
        if chain:
            return stitched(a, b, chain, k)
        k //= 2
    one, two = fill(a[: len(a) // 2], b[: len(b) // 2], k), fill(a[len(a) // 2 :], b[len(b) // 2 :], k)
    return one[0] + two[0], one[1] + two[1]


def runs(chain: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(place in one, place in the other, letters) of stretches that a rising chain's anchors cover without a gap or a shift."""
    if not len(chain):
        return []
    step = np.diff(chain, axis=0)
    first = np.flatnonzero(np.concatenate([[True], (step[:, 0] != step[:, 1]) | (step[:, 0] > k)]))
    last = np.append(first[1:], len(chain)) - 1
    return np.column_stack([chain[first], chain[last, 0] - chain[first, 0] + k]).tolist()


def stitched(a: str, b: str, chain: np.ndarray | list[tuple[int, int]], k: int) -> tuple[str, str]:
    """Both texts with gaps: anchors as they are, what lies between filled; anchors that overlap the one before are cut short or left out."""
    left, right, i, j = [], [], 0, 0
    for p, q, n in [*runs(np.asarray(chain, np.int64).reshape(-1, 2), k), (len(a), len(b), 0)]:
        skip = max(i - p, j - q, 0)
        if n and skip >= n:
            continue
        u, v = fill(a[i : p + skip], b[j : q + skip], k // 2)
        left += [u, a[p + skip : p + n]]
        right += [v, b[q + skip : q + n]]
        i, j = p + max(skip, n), q + max(skip, n)
    return "".join(left), "".join(right)


def seeded_alignments(pairs: DataFrame, k: int = 25) -> DataFrame:
    """pairs: pair, one, two and any more columns -> all of them, and left, right: both texts with gaps ('-').

    A pair's texts are in one row, so its seeds are found where it is aligned: a row is shuffled once, whatever other rows have its pair.
    Texts of fewer than 3 k letters have no seeds and are aligned whole; a null text is an empty one. Stretches
    between anchors are aligned exactly up to ``CELLS`` cells; longer ones by seeds of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, start, size = [], 0, 0
            for n, (a, b) in enumerate(zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True), 1):
                a, b = a or "", b or ""
                out.append(stitched(a, b, seed_chain(a, b, k) if min(len(a), len(b)) >= 3 * k else [], k))
                size += len(a) + len(b)
                if size > FRAME or n == batch.num_rows:
                    sides = [pa.array([x[side] for x in out], pa.string()) for side in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, n - start).columns, *sides], [*batch.schema.names, "left", "right"])
                    out, start, size = [], n, 0

    kinds = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartition(parts).mapInArrow(run, f"{kinds}, left string, right string")
