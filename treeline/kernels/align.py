"""Affine alignment of sequences and profiles."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np

AMINO = "ARNDCQEGHILKMFPSTWYV"
#: The BLOSUM62 matrix, lower triangle by rows in the order of AMINO.
BLOSUM62 = """4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4"""


def blosum() -> np.ndarray:
    m = np.zeros((20, 20))
    for i, line in enumerate(BLOSUM62.split("\n")):
        for j, v in enumerate(line.split()):
            m[i, j] = m[j, i] = float(v)
    return m


def profile_scores(profile: np.ndarray, residues: str, empty: float = -2.0) -> np.ndarray:
    """[column, residue] expected substitution score of a frequency profile; an empty column scores ``empty``."""
    at = np.array([AMINO.find(c) for c in residues])
    s = profile @ np.where(at >= 0, blosum()[:, np.maximum(at, 0)], -1.0)
    s[profile.sum(1) == 0] = empty
    return s


def align(scores: np.ndarray, opening: float = -10.0, extension: float = -0.5, local: bool = False, most_cells: int = 100_000_000) -> tuple[float, list[tuple[int | None, int | None]]]:
    """Affine alignment of two axes of a score matrix: (score, pairs of places, None for a gap)."""
    n, m = scores.shape
    if (n + 1) * (m + 1) > most_cells:
        raise ValueError("the alignment has too many cells")
    low = -1e18
    h, e, f = np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low)
    h[0, 0], place = 0, np.arange(m + 1)
    edge = lambda k: 0.0 if local else opening + extension * (k - 1)
    for i in range(1, n + 1):
        h[i, 0] = f[i, 0] = edge(i)
    for j in range(1, m + 1):
        h[0, j] = e[0, j] = edge(j)
    for i in range(1, n + 1):
        f[i, 1:] = np.maximum(h[i - 1, 1:] + opening, f[i - 1, 1:] + extension)
        diagonal = np.maximum(h[i - 1, :-1] + scores[i - 1], f[i, 1:])
        if local:
            diagonal = np.maximum(diagonal, 0)
        if opening <= extension:  # a gap never opens again where it could go on: a running maximum gives the row
            reach = np.maximum.accumulate(np.concatenate([h[i, :1], diagonal]) - extension * place)
            e[i, 1:] = reach[:-1] + opening + extension * (place[1:] - 1)
            h[i, 1:] = np.maximum(diagonal, e[i, 1:])
            continue
        for j in range(1, m + 1):
            e[i, j] = max(h[i, j - 1] + opening, e[i, j - 1] + extension)
            h[i, j] = max(diagonal[j - 1], e[i, j])
    near = lambda x, y: abs(x - y) <= 1e-8 + 1e-5 * abs(y)  # noqa: E731  as isclose, of two numbers
    i, j = np.unravel_index(int(h.argmax()), h.shape) if local else (n, m)
    i, j = int(i), int(j)
    best, pairs, layer = float(h[i, j]), [], "h"
    while i or j:
        if local and layer == "h" and h[i, j] <= 0:
            break
        if layer == "h":
            if i and j and near(h[i, j], h[i - 1, j - 1] + scores[i - 1, j - 1]):
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif i and near(h[i, j], f[i, j]):
                layer = "f"
            else:
                layer = "e"
        elif layer == "f":
            layer = "h" if i == 1 and not j or near(f[i, j], h[i - 1, j] + opening) else "f"
            i -= 1
            pairs.append((i, None))
        else:
            layer = "h" if j == 1 and not i or near(e[i, j], h[i, j - 1] + opening) else "e"
            j -= 1
            pairs.append((None, j))
    return best, pairs[::-1]


def local_extent(n: int, row: Callable[[int], np.ndarray], m: int, opening: float = -10.0, extension: float = -0.5) -> tuple[float, int]:
    """(score, number of pairs and gaps) of the local alignment that ``align`` finds, by one pass that holds a few rows.

    ``row`` gives the scores of a place of the first axis. Every cell carries the length of its way back, by the
    same choices: the diagonal first, then a gap in the second axis, then one in the first; a gap is opened where it can be.
    Opening must cost more than extension.
    """
    place = np.arange(m + 1, dtype=np.int32)
    slope = extension * place
    h, f, length, f_length = np.zeros(m + 1), np.full(m + 1, -1e18), np.zeros(m + 1, np.int32), np.zeros(m + 1, np.int32)
    best, extent = 0.0, 0
    for i in range(n):
        opened, went = h + opening, f + extension
        f_length = np.where(opened >= went - 1e-9, length, f_length) + 1
        f = np.maximum(opened, went)
        f[0] = -1e18
        diagonal = h[:-1] + row(i)
        now = np.empty(m + 1)
        now[0] = 0.0
        np.maximum(diagonal, f[1:], out=now[1:])
        np.maximum(now, 0.0, out=now)
        own = np.zeros(m + 1, np.int32)
        own[1:] = np.where(diagonal >= now[1:] - 1e-9, length[:-1] + 1, f_length[1:])
        own[now <= 0] = 0
        lifted = now - slope
        reach = np.maximum.accumulate(lifted)
        e = reach[:-1] + opening + slope[:-1]
        if (e > now[1:]).any():
            # the nearest place from which a gap is worth as much
            start = np.maximum.accumulate(np.where(lifted >= reach - 1e-9, place, 0))[:-1]
            longer = np.flatnonzero(e > now[1:] + 1e-9)
            own[longer + 1] = own[start[longer]] + longer + 1 - start[longer]
            np.maximum(now[1:], e, out=now[1:])
        h, length = now, own
        k = int(h.argmax())
        if h[k] > best:
            best, extent = float(h[k]), int(length[k])
    return best, extent


def _far(n: int, row: Callable[[int], np.ndarray], m: int, opening: float, extension: float) -> tuple[float, float]:
    """The most that a global alignment from the corner is worth in any cell of the last row, and of the last column."""
    place = np.arange(m + 1)
    h = np.concatenate([[0.0], opening + extension * place[:-1]])
    f, side = np.full(m + 1, -1e18), h[-1]
    for i in range(n):
        f = np.maximum(h + opening, f + extension)
        now = f.copy()
        np.maximum(h[:-1] + row(i), f[1:], out=now[1:])
        reach = np.maximum.accumulate(now - extension * place)
        np.maximum(now[1:], reach[:-1] + opening + extension * place[:-1], out=now[1:])
        h = now
        side = max(side, h[-1])
    return float(h.max()), float(side)


def local_end(scores: np.ndarray, letters: np.ndarray, opening: int, extension: int, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[int, int, int, tuple[np.ndarray, np.ndarray]]:
    """(best score, its first place in the profile, its first letter, state after the last letter) of local alignments in whole numbers.

    scores: [letter of the alphabet, place in the profile]. Places are stepped together, letter by letter. Scores below the price of
    a gap open none, so gaps are followed only from the few cells above it. state: scores and open gaps of all places before the first letter.
    """
    n = scores.shape[1]
    if scores.dtype == np.int32 and n * -extension > 1 << 30:
        raise OverflowError
    slope = extension * np.arange(n, dtype=scores.dtype)
    was, now = np.zeros(n + 1, scores.dtype), np.zeros(n + 1, scores.dtype)
    gap, hot = np.zeros(n, scores.dtype), np.zeros(0, np.int64)
    if state is not None:
        was[1:], gap[:] = state
        hot = np.flatnonzero(was[1:] > -opening)
    open_gaps, over = np.flatnonzero(gap), np.empty(n, bool)
    best, where, letter = 0, -1, -1
    for j, row in enumerate(scores[k] for k in letters):
        cells = now[1:]
        np.add(was[:-1], row, out=cells)
        np.maximum(cells, 0, out=cells)
        if len(open_gaps):
            left = np.maximum(gap[open_gaps] + extension, 0)
            gap[open_gaps] = left
            open_gaps = open_gaps[left > 0]
        if len(hot):
            opened, had = was[1:][hot] + opening, gap[hot]
            gap[hot] = np.maximum(had, opened)
            open_gaps = np.concatenate([open_gaps, hot[had == 0]])
        if len(open_gaps):
            cells[open_gaps] = np.maximum(cells[open_gaps], gap[open_gaps])
        np.greater(cells, -opening, out=over)
        hot = np.flatnonzero(over)
        if len(hot):
            high = cells[hot]
            k = int(high.argmax())
            top, at = int(high[k]), int(hot[k])
            # all cells that a gap along the profile reaches with a score above 0
            far = np.minimum((high + opening - extension - 1) // -extension, n - 1 - hot)
            count = int(far.sum())
            if count > n // 4:
                reach = np.maximum.accumulate(cells - slope)[:-1]
                np.maximum(cells[1:], reach + slope[:-1] + opening, out=cells[1:])
                hot = np.flatnonzero(np.greater(cells, -opening, out=over))
            else:
                first = np.cumsum(far) - far
                step = np.arange(count) - np.repeat(first, far)
                place = np.repeat(hot + 1, far) + step
                value = (np.repeat(high + opening, far) + extension * step).astype(scores.dtype)
                higher = value > cells[place]
                if higher.any():
                    place, value = place[higher], value[higher]
                    np.maximum.at(cells, place, value)
                    more = place[value > -opening]
                    if len(more):
                        hot = np.union1d(hot, more)
        elif best <= -opening:
            at = int(cells.argmax())
            top = int(cells[at])
        else:
            top = 0
        if top > best or top == best and top > 0 and at < where:
            best, where, letter = top, at, j
            if best > 1 << 30 and scores.dtype == np.int32:
                raise OverflowError
        was, now = now, was
    return best, where, letter, (was[1:], gap)


def way_back(scores: np.ndarray, letters: np.ndarray, i: int, j: int, whole: int, opening: float, extension: float, from_start: bool = True, reach: int = 128) -> int:
    """Number of pairs and gaps of the local alignment that ends at place i and letter j with the best score of all, as ``local_extent`` counts them.

    scores: as ``local_end`` has them, in parts of ``whole``. It is looked for in a square that no way of the same score can leave.
    from_start: whether nothing comes before the first letter; else a way that may come from there gives -1.
    """
    while True:
        a, b = max(0, i + 1 - reach), max(0, j + 1 - reach)
        near, n = letters[b : j + 1], i + 1 - a
        bottom, side = _far(n, lambda k: (scores[:, i - k] / whole)[near[::-1]], len(near), opening, extension)  # noqa: B023
        if (not a or bottom < -1e-6) and (not b and from_start or side < -1e-6):
            return local_extent(n, lambda k: (scores[:, a + k] / whole)[near], len(near), opening, extension)[1]  # noqa: B023
        if not a and not b:
            return -1
        reach *= 2


def align_text(a: str, b: str, match: float = 2.0, mismatch: float = -1.0, opening: float = -4.0, extension: float = -1.0) -> tuple[str, str, float]:
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    score, pairs = align(np.where(x[:, None] == y[None, :], match, mismatch), opening, extension)
    return "".join("-" if i is None else a[i] for i, _ in pairs), "".join("-" if j is None else b[j] for _, j in pairs), score


def near_text(a: str, b: str, match: int = 2, mismatch: int = -1, opening: int = -4, extension: int = -1, width: int = 8) -> tuple[str, str]:
    """What ``align_text`` gives of two texts that aren't empty, from the cells near the diagonals that join their ends.

    A way that leaves a band has gaps on both sides, so its score is bounded. The band grows until its best way is above the
    bound; then every best way is within it and the choices between them are those of the whole matrix.
    """
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.int32) for s in (a, b))
    n, m, low = len(a), len(b), -(10**8)
    short, apart = min(n, m), abs(n - m)
    while True:
        # cell (i, j) is in column j - i - start of row i
        start, end = max(-n, min(0, m - n) - width), min(m, max(0, m - n) + width)
        wide = end - start + 1
        column = np.arange(wide, dtype=np.int32)
        padded = np.full(n + wide, -1, np.int32)
        part = y[: n + wide + start]
        padded[-start : len(part) - start] = part
        same = np.lib.stride_tricks.sliding_window_view(padded, wide)[:n] == x[:, None]
        scores = np.where(same, np.int32(match), np.int32(mismatch))
        h, e, f = (np.full((n + 1, wide), low, np.int32) for _ in range(3))
        h[0, -start:] = e[0, -start:] = opening + extension * (column[-start:] + start - 1)
        h[0, -start], e[0, -start] = 0, low
        slope, open_slope = extension * column, opening + extension * (column[1:] - 1)
        for i in range(1, n + 1):
            was, now, down = h[i - 1], h[i], f[i]
            np.maximum(was[1:] + opening, f[i - 1, 1:] + extension, out=down[:-1])
            np.add(was, scores[i - 1], out=now)
            np.maximum(now, down, out=now)
            reach = np.maximum.accumulate(now - slope)
            np.add(reach[:-1], open_slope, out=e[i, 1:])
            np.maximum(now, e[i], out=now)
        score = int(h[n, m - n - start])
        if start == -n and end == m or score > match * (short - width - 1) + 2 * opening + extension * (apart + 2 * width):
            break
        enough = (match * (short - 1) + 2 * opening + extension * apart - score) // (match - 2 * extension) + 1
        width = min(enough, 4 * width)
    diagonal = np.ascontiguousarray((h[1:] == h[:-1] + scores).T)
    left, right, i, j, layer = [], [], n, m, "h"
    while i and j:
        c = j - i - start
        if layer == "h":
            run = i - 1 - diagonal[c, :i].tobytes().rfind(0)
            run = min(run, i, j)
            if run:
                left.append(a[i - run : i][::-1])
                right.append(b[j - run : j][::-1])
                i, j = i - run, j - run
            else:
                layer = "f" if h[i, c] == f[i, c] else "e"
        elif layer == "f":
            layer = "h" if f[i, c] == h[i - 1, c + 1] + opening else "f"
            i -= 1
            left.append(a[i])
            right.append("-")
        else:
            layer = "h" if e[i, c] == h[i, c - 1] + opening else "e"
            j -= 1
            left.append("-")
            right.append(b[j])
    left += [a[:i][::-1], "-" * j]
    right += ["-" * i, b[:j][::-1]]
    return "".join(left)[::-1], "".join(right)[::-1]


def seeded(a: str, b: str, k: int = 25) -> tuple[str, str]:
    """Anchored by k-mers that are unique in both, in their longest rising chain; short texts are aligned whole."""
    if min(len(a), len(b)) < 3 * k:
        return align_text(a, b)[:2]

    def unique(s: str) -> dict[str, int]:
        seen: dict[str, int] = {}
        for i in range(len(s) - k + 1):
            seen[s[i : i + k]] = -1 if s[i : i + k] in seen else i
        return {w: i for w, i in seen.items() if i >= 0}

    x, y = unique(a), unique(b)
    shared = sorted((x[w], y[w]) for w in x.keys() & y.keys())
    tails, back, at = [], [], []
    for n, (_, j) in enumerate(shared):
        p = bisect.bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        tails[p : p + 1] = [j]
        at[p : p + 1] = [n]
    chain, n = [], at[-1] if at else -1
    while n >= 0:
        chain.append(shared[n])
        n = back[n]
    left, right, i, j = [], [], 0, 0
    for p, q in [*reversed(chain), (len(a), len(b))]:
        if p < i or q < j:
            continue  # overlaps the anchor before
        if p > i or q > j:
            u, v = align_text(a[i:p], b[j:q])[:2] if p > i and q > j else (a[i:p] + "-" * (q - j), "-" * (p - i) + b[j:q])
            left.append(u)
            right.append(v)
        step = k if p < len(a) else 0
        left.append(a[p : p + step])
        right.append(b[q : q + step])
        i, j = p + step, q + step
    return "".join(left), "".join(right)


def infer_frame(columns: list[str], reference: str) -> list[int]:
    """Phase (0, 1, 2) of each alignment column, -1 where the reference has a gap: its letters are counted from the start."""
    out, n = [], 0
    for c in reference:
        out.append(-1 if c == "-" else n % 3)
        n += c != "-"
    return out


def frame_corrected(sequences: list[str], reference: int = 0) -> list[str]:
    """Only the columns that the reference has, cut to whole codons."""
    keep = [k for k, p in enumerate(infer_frame(sequences, sequences[reference])) if p >= 0]
    keep = keep[: len(keep) // 3 * 3]
    return ["".join(s[k] for k in keep) for s in sequences]
