"""Hidden Markov chains and segmentations of one sequence of sites."""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np

#: Below any sum of whole weights.
NEVER = -(1 << 60)


def decode(emissions: np.ndarray, initial: np.ndarray, transition: np.ndarray) -> dict[str, np.ndarray]:
    """Log emissions [site, state], log initial and log transitions -> posterior, path, switch posterior, log likelihood."""
    n, k = emissions.shape
    forward, backward = np.empty((n, k)), np.zeros((n, k))
    best, back = np.empty((n, k)), np.zeros((n, k), int)
    forward[0] = best[0] = initial + emissions[0]
    for t in range(1, n):
        forward[t] = np.logaddexp.reduce(forward[t - 1][:, None] + transition, axis=0) + emissions[t]
        step = best[t - 1][:, None] + transition
        back[t] = step.argmax(0)
        best[t] = step.max(0) + emissions[t]
    for t in range(n - 2, -1, -1):
        backward[t] = np.logaddexp.reduce(transition + (emissions[t + 1] + backward[t + 1])[None, :], axis=1)
    total = np.logaddexp.reduce(forward[-1])
    path = np.empty(n, int)
    path[-1] = best[-1].argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    stay = np.zeros(n)
    for t in range(1, n):
        stay[t] = np.exp(forward[t - 1] + np.diag(transition) + emissions[t] + backward[t] - total).sum()
    switch = 1 - stay
    switch[0] = 0
    return {"posterior": np.exp(forward + backward - total), "path": path, "switch": switch, "logl": total}


def reset_chain(logl: np.ndarray, weights: np.ndarray, q: float) -> dict[str, np.ndarray]:
    """Transitions (1 - q) I + q 1 w: forward, backward and expected resets in time linear in states."""
    n, k = logl.shape
    top = logl.max(1, keepdims=True)
    e = np.exp(logl - top)
    forward, scale = np.empty((n, k)), np.empty(n)
    at = weights * e[0]
    scale[0] = at.sum()
    forward[0] = at / scale[0]
    for t in range(1, n):
        at = ((1 - q) * forward[t - 1] + q * weights) * e[t]
        scale[t] = at.sum()
        forward[t] = at / scale[t]
    backward = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        x = e[t + 1] * backward[t + 1]
        backward[t] = ((1 - q) * x + q * (weights @ x)) / scale[t + 1]
    posterior = forward * backward
    resets = np.zeros((n, k))
    resets[0] = posterior[0]
    for t in range(1, n):
        resets[t] = q * weights * e[t] * backward[t] / scale[t]
    return {"posterior": posterior, "resets": resets, "logl": float(np.log(scale).sum() + top.sum())}


def fit_reset(logl: np.ndarray, q: float, steps: int = 50, pseudo: float = 0.05, tolerance: float = 1e-6) -> tuple[np.ndarray, dict]:
    """Weights of the reset chain by EM with a small pseudo-count."""
    k = logl.shape[1]
    w = np.full(k, 1 / k)
    for _ in range(steps):
        found = reset_chain(logl, w, q)
        after = found["resets"].sum(0) + pseudo
        after /= after.sum()
        moved = np.abs(after - w).max()
        w = after
        if moved < tolerance:
            break
    return w, reset_chain(logl, w, q)


def fit_rates(logl: np.ndarray, expected: list[float]) -> dict:
    """Average over expected numbers of resets by evidence: posterior, weights, log evidence of each."""
    n = len(logl)
    fits = [fit_reset(logl, min(0.5, r / n)) for r in expected]
    evidence = np.array([f["logl"] for _, f in fits])
    share = np.exp(evidence - evidence.max())
    share /= share.sum()
    return {"posterior": sum(s * f["posterior"] for s, (_, f) in zip(share, fits, strict=True)), "weights": sum(s * w for s, (w, _) in zip(share, fits, strict=True)), "rates": share, "logl": float(evidence.max() + np.log(np.exp(evidence - evidence.max()).mean()))}


def reset_viterbi(logl: np.ndarray, weights: np.ndarray, q: float) -> np.ndarray:
    """Best path in time linear in states: to enter a state only the best other state matters."""
    n, k = logl.shape
    with np.errstate(divide="ignore"):
        enter, stay = np.log(q * weights), np.log(1 - q + q * weights)
        at = np.log(weights) + logl[0]
    back = np.empty((n, k), int)
    for t in range(1, n):
        first = int(at.argmax())
        rest = at.copy()
        rest[first] = -np.inf
        second = int(rest.argmax())
        other = np.full(k, first)
        other[first] = second
        move, hold = at[other] + enter, at + stay
        back[t] = np.where(hold >= move, np.arange(k), other)
        at = np.maximum(hold, move) + logl[t]
    path = np.empty(n, int)
    path[-1] = at.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def fit_trees(logl: np.ndarray, expected: list[float], least_sites: float = 5.0, beam: int = 4) -> dict:
    """Tree HMM: beam search over subsets of states with add, drop and swap, scored by evidence less a BIC-like charge; then states that the path leaves out go."""
    n, k = logl.shape
    known: dict[tuple[int, ...], tuple[float, dict]] = {}

    def score(subset: tuple[int, ...]) -> float:
        if subset not in known:
            fit = fit_rates(logl[:, subset], expected) if len(subset) > 1 else {"posterior": np.ones((n, 1)), "weights": np.ones(1), "rates": np.array([1.0]), "logl": float(logl[:, subset[0]].sum())}
            known[subset] = (fit["logl"] - 0.5 * (2 * len(subset) - 1) * np.log(n), fit)
        return known[subset][0]

    front = sorted(((s,) for s in range(k)), key=score, reverse=True)[:beam]
    while True:
        best = max(map(score, front))
        near = {tuple(sorted({*f, s})) for f in front for s in range(k)} | {tuple(x for x in f if x != s) for f in front for s in f if len(f) > 1}
        near |= {tuple(sorted({*(x for x in f if x != s), u})) for f in front for s in f for u in range(k)}
        front = sorted({*near, *front}, key=lambda f: (-score(f), f))[:beam]
        if score(front[0]) <= best + 1e-9:
            break
    states = front[0]
    while len(states) > 1:
        fit = known[states][1] if states in known else (score(states), known[states][1])[1]
        path = reset_viterbi(logl[:, states], fit["weights"], min(0.5, float(fit["rates"] @ np.array(expected)) / n))
        used = tuple(s for i, s in enumerate(states) if (path == i).sum() >= least_sites)
        if not used or used == states:
            break
        states = used
    score(states)
    fit = known[states][1]
    path = reset_viterbi(logl[:, states], fit["weights"], min(0.5, float(fit["rates"] @ np.array(expected)) / n)) if len(states) > 1 else np.zeros(n, int)
    return {"states": states, "path": np.array(states)[path], "posterior": fit["posterior"], "score": known[states][0]}


def merge_short_runs(path: np.ndarray, logl: np.ndarray, least: int) -> np.ndarray:
    """Gives the shortest run below the least length to the neighbour that fits it better, again and again."""
    path = path.copy()
    while True:
        edges = np.flatnonzero(np.diff(path)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(path)]])
        sizes = ends - starts
        if len(sizes) < 2 or sizes.min() >= least:
            return path
        k = int(sizes.argmin())
        a, b = starts[k], ends[k]
        options = [int(path[a - 1])] * (k > 0) + [int(path[b])] * (k < len(sizes) - 1)
        path[a:b] = max(options, key=lambda s: (logl[a:b, s].sum(), -s))


def semi_markov(cost: np.ndarray, jump: np.ndarray, least: int) -> tuple[np.ndarray, float]:
    """Cheapest path of segments of at least ``least`` sites; cost [site, state], jump [state, state]."""
    n, k = cost.shape
    prefix = np.concatenate([np.zeros((1, k)), np.cumsum(cost, axis=0)])
    best, came, opened = np.full((n + 1, k), np.inf), np.full((n + 1, k), -1), np.zeros((n + 1, k), int)
    entry, entry_at, entry_from = np.full(k, np.inf), np.zeros(k, int), np.full(k, -1)
    for t in range(least, n + 1):
        s = t - least  # a segment may start at s and end at t
        if s == 0:
            enter, source = np.zeros(k), np.full(k, -1)
        else:
            step = best[s][:, None] + jump
            np.fill_diagonal(step, np.inf)
            enter, source = step.min(0), step.argmin(0)
        offer = enter - prefix[s]
        better = offer < entry
        entry = np.where(better, offer, entry)
        entry_at, entry_from = np.where(better, s, entry_at), np.where(better, source, entry_from)
        best[t], came[t], opened[t] = entry + prefix[t], entry_from, entry_at
    path, t, state = np.zeros(n, int), n, int(best[n].argmin())
    total = float(best[n, state])
    while t > 0:
        s = int(opened[t, state])
        path[s:t] = state
        state, t = int(came[t, state]), s
    return path, total


def graph_path(cost: np.ndarray, edges: list[tuple[int, int]], switch: float) -> tuple[np.ndarray, float]:
    """Cheapest path of states where a switch follows one or more edges, each at a price: min-plus with all-pairs steps."""
    k = cost.shape[1]
    step = np.full((k, k), np.inf)
    np.fill_diagonal(step, 0)
    for a, b in edges:
        step[a, b] = step[b, a] = switch
    for m in range(k):
        step = np.minimum(step, step[:, m, None] + step[None, m, :])
    at, back = cost[0].copy(), []
    for t in range(1, len(cost)):
        x = at[:, None] + step
        back.append(x.argmin(0))
        at = x.min(0) + cost[t]
    path = [int(at.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1]), float(at.min())


def mask_path(cost: np.ndarray, bits: int, price: np.ndarray) -> tuple[np.ndarray, float]:
    """Cheapest path over all masks where each flipped bit has a price: the min-plus step factors over bits."""
    at, held = cost[0].copy(), [cost[0].copy()]
    for t in range(1, len(cost)):
        v = at.copy()
        for b in range(bits):
            v = np.minimum(v, v[np.arange(len(v)) ^ (1 << b)] + price[b])
        at = v + cost[t]
        held.append(at.copy())
    masks = np.arange(1 << bits)
    flips = lambda a: sum(price[b] * (((masks ^ a) >> b) & 1) for b in range(bits))
    path = [int(held[-1].argmin())]
    for t in range(len(cost) - 2, -1, -1):
        path.append(int((held[t] + flips(path[-1])).argmin()))
    return np.array(path[::-1]), float(held[-1].min())


def suppress(positions: np.ndarray, scores: np.ndarray, apart: float, most: int) -> list[int]:
    """Greedy: best first (ties by position), none within ``apart`` of one that is taken."""
    taken: list[int] = []
    for k in np.lexsort((positions, -scores)):
        if len(taken) == most:
            break
        if all(abs(positions[k] - positions[j]) >= apart for j in taken):
            taken.append(int(k))
    return taken


def weighted_intervals(starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, apart: int, most: int) -> list[int]:
    """The heaviest set of at most ``most`` intervals with at least ``apart`` sites between neighbours."""
    order = np.lexsort((starts, ends))
    e = ends[order]
    before = np.searchsorted(e, starts[order] - apart, "right")
    n = len(order)
    best = np.zeros((most + 1, n + 1))
    for m in range(1, most + 1):
        best[m, 1:] = np.maximum.accumulate(np.maximum(best[m - 1, before] + weights[order], 0.0))
    out, m, i = [], most, n
    while m and i:
        if best[m, i] == best[m, i - 1]:
            i -= 1
        else:
            out.append(int(order[i - 1]))
            i, m = int(before[i - 1]), m - 1
    return out[::-1]


def spaced_fold(at: np.ndarray, weights: np.ndarray, start: int, width: int, apart: int) -> np.ndarray:
    """[what entered, what leaves]: best sums of points ``apart`` from each other among ``width`` places from ``start``, as a max-plus matrix.

    A state is a best sum up to each of the last ``apart`` places, the nearest first; weights are whole numbers, so nothing depends on the order of sums.
    """
    state = np.full((apart, apart), NEVER)
    np.fill_diagonal(state, 0)
    out = [*state[::-1]]  # the furthest place first, then those of this block
    w = dict(zip((at - start).tolist(), weights.tolist(), strict=True))
    for x in range(width):
        best = out[-1]
        if x in w:
            best = np.maximum(best, out[-apart] + w[x])
        out = [*out[1 - apart :], best] if apart > 1 else [best]
    return np.stack(out[::-1], 1)


def spaced_walk(at: np.ndarray, weights: np.ndarray, start: int, width: int, apart: int, entered: np.ndarray, limits: list[int]) -> list[tuple[list[int], int]]:
    """For each limit, that many places left of the block's last one: (points taken up to it, last first; the limit for the block before).

    A point is taken only if it makes the sum larger, from the right, as ``weighted_intervals`` does.
    """
    v = entered[::-1].tolist()
    w = dict(zip((at - start).tolist(), weights.tolist(), strict=True))
    for x in range(width):
        v.append(max(v[-1], v[-apart] + w[x]) if x in w else v[-1])
    places, out = sorted(w), []
    for limit in limits:
        x, taken = width - 1 - limit, []
        while x >= 0:
            k = bisect.bisect_right(places, x) - 1
            if k < 0:
                x = -1
                break
            x = places[k]
            if v[apart + x] > v[apart + x - 1]:
                taken.append(start + x)
                x -= apart
            else:
                x -= 1
        out.append((taken, -1 - x))
    return out


def match_breakpoints(found: list[int], truth: list[int], tolerance: int) -> tuple[int, int]:
    """(matches, total error) of an ordered one-to-one matching: most matches first, then least error."""
    a, b = sorted(found), sorted(truth)
    best = {(i, 0): (0, 0) for i in range(len(a) + 1)} | {(0, j): (0, 0) for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        options = [best[i - 1, j], best[i, j - 1]]
        if (gap := abs(a[i - 1] - b[j - 1])) <= tolerance:
            n, e = best[i - 1, j - 1]
            options.append((n + 1, e - gap))
        best[i, j] = max(options)
    n, e = best[len(a), len(b)]
    return n, -e


def triplet_switches(positions: np.ndarray, states: np.ndarray, expected: np.ndarray, sites: int, accuracy: float) -> tuple[np.ndarray, np.ndarray]:
    """(probability of a switch in each gap between events, weight of each expected number of switches).

    The three-state chain runs in continuous time over the sites and is solved for all rates at once; a state is
    left for either other one at equal rates, and rates are averaged by their evidence.
    """
    n = len(states)
    rates = 1.5 * np.asarray(expected, float) / max(1, sites - 1)
    e = np.full((n, 3), (1 - accuracy) / 2)
    e[np.arange(n), states] = accuracy
    stay = np.exp(-np.maximum(1, np.diff(positions))[:, None] * rates)
    forward, scale = np.empty((n, len(rates), 3)), np.empty((n, len(rates)))
    at = np.broadcast_to(e[0] / 3, (len(rates), 3))
    for t in range(n):
        if t:
            at = (stay[t - 1][:, None] * forward[t - 1] + (1 - stay[t - 1][:, None]) / 3) * e[t]
        scale[t] = at.sum(1)
        forward[t] = at / scale[t][:, None]
    switch, after = np.empty((n - 1, len(rates))), np.ones((len(rates), 3))
    for t in range(n - 2, -1, -1):
        x = e[t + 1] * after / scale[t + 1][:, None]
        switch[t] = 1 - (forward[t] * x).sum(1) * stay[t] - (forward[t] * x).sum(1) * (1 - stay[t]) / 3
        after = stay[t][:, None] * x + (1 - stay[t][:, None]) * x.mean(1, keepdims=True)
    evidence = np.log(scale).sum(0)
    weight = np.exp(evidence - evidence.max())
    weight /= weight.sum()
    return np.maximum(switch @ weight, 0.0), weight


def _laned(stay: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stay [step, lane, rate], emission [step, lane, state]) of events cut into lanes that are stepped together; what is missing in the last lane changes nothing."""
    n = len(e)
    lanes = max(1, math.isqrt(n))
    steps = -(-n // lanes)
    s, x = np.ones((lanes * steps, stay.shape[1])), np.ones((lanes * steps, 3))
    s[:n], x[:n] = stay, e
    return s.reshape(lanes, steps, -1).swapaxes(0, 1), x.reshape(lanes, steps, 3).swapaxes(0, 1)


def _lane_products(stay: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix [lane, rate, 3, 3] of sum 3, log of what it was divided by [lane, rate])."""
    lanes, rates = stay.shape[1:]
    m, log = np.broadcast_to(np.eye(3), (lanes, rates, 3, 3)), np.zeros((lanes, rates))
    for s, x in zip(stay, e, strict=True):
        m = (s[:, :, None, None] * m + ((1 - s) / 3)[:, :, None, None] * m.sum(3, keepdims=True)) * x[:, None, None, :]
        scale = m.sum((2, 3)) / 3
        m, log = m / scale[:, :, None, None], log + np.log(scale)
    return m, log


def switch_stays(gaps: np.ndarray, expected: np.ndarray, sites: int) -> np.ndarray:
    """Probability [event, rate] that nothing was drawn since the event before; the first event of a chain comes with an endless gap."""
    return np.exp(-np.maximum(1, gaps)[:, None] * (1.5 * np.asarray(expected, float) / max(1, sites - 1)))


def switch_emissions(states: np.ndarray, accuracy: float) -> np.ndarray:
    e = np.full((len(states), 3), (1 - accuracy) / 2)
    e[np.arange(len(states)), states] = accuracy
    return e


def switch_fold(stay: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix [rate, 3, 3], its log factor [rate]) of a stretch of a triplet's chain."""
    every, logs = _lane_products(*_laned(stay, e))
    m, log = every[0], logs.sum(0)
    for other in every[1:]:
        m = m @ other
        scale = m.sum((1, 2)) / 3
        m, log = m / scale[:, None, None], log + np.log(scale)
    return m, log


def switch_block(stay: np.ndarray, e: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Probability [event, rate] that the state changed in the gap before each event of a stretch, given vectors [rate, state] from both sides."""
    n = len(e)
    s, x = _laned(stay, e)
    products, _ = _lane_products(s, x)
    steps, lanes, rates = s.shape
    f, b = np.empty((lanes, rates, 3)), np.empty((lanes, rates, 3))
    for k in range(lanes):
        f[k] = before / before.sum(1, keepdims=True)
        before = (f[k][:, None, :] @ products[k])[:, 0]
    for k in range(lanes - 1, -1, -1):
        b[k] = after / after.sum(1, keepdims=True)
        after = (products[k] @ b[k][:, :, None])[:, :, 0]
    came = np.empty((steps, lanes, rates, 3))
    for t in range(steps):
        came[t] = f
        f = (s[t][:, :, None] * f + ((1 - s[t]) / 3)[:, :, None]) * x[t][:, None, :]
        f /= f.sum(2, keepdims=True)
    out = np.empty((steps, lanes, rates))
    for t in range(steps - 1, -1, -1):
        y = x[t][:, None, :] * b
        drawn, same = (1 - s[t]) / 3, (came[t] * y).sum(2)
        every = y.sum(2)
        out[t] = drawn * (every - same) / (s[t] * same + drawn * every)
        b = s[t][:, :, None] * y + drawn[:, :, None] * every[:, :, None]
        b /= b.sum(2, keepdims=True)
    return np.maximum(out.swapaxes(0, 1).reshape(lanes * steps, rates)[:n], 0.0)


def climb_mode(values: np.ndarray, start: int) -> tuple[int, int, int]:
    """(mode, left end, right end) of the basin that a hill climb reaches on values smoothed by 1, 2, 1 over what is there; ties go left."""
    taps = np.array([1.0, 2.0, 1.0])
    v = np.convolve(values, taps)[1:-1] / np.convolve(np.ones(len(values)), taps)[1:-1]
    at = lambda j: v[j] if 0 <= j < len(v) else -np.inf
    k = start
    while max(at(k - 1), at(k + 1)) > v[k]:
        k += -1 if at(k - 1) >= at(k + 1) else 1
    a = b = k
    while a > 0 and v[a - 1] <= v[a]:
        a -= 1
    while b < len(v) - 1 and v[b + 1] <= v[b]:
        b += 1
    return k, a, b


def mass_position(weights: np.ndarray, share: float) -> int:
    """First index whose running sum reaches a share of the total; in proportion to the length if all are zero."""
    total = weights.sum()
    return int(np.searchsorted(np.cumsum(weights), share * total)) if total > 0 else round(share * (len(weights) - 1))


def low_switch_states(logl: np.ndarray, q: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(states that stay, path over them) of a reset chain with even weights: states that the smoothed best path leaves out are dropped until none is."""
    kept = np.arange(logl.shape[1])
    while True:
        here = logl[:, kept]
        path = merge_short_runs(reset_viterbi(here, np.full(len(kept), 1 / len(kept)), q), here, least)
        used = np.unique(path)
        if len(used) == len(kept):
            return kept, kept[path]
        kept = kept[used]


def proxy_weights(logl: np.ndarray, pseudo: float = 0.05) -> np.ndarray:
    """Weights of the states of a reset chain, from the sum of each one's share of every site."""
    share = np.exp(np.maximum(-60, logl - logl.max(1, keepdims=True)))
    weight = pseudo + (share / share.sum(1, keepdims=True)).sum(0)
    return weight / weight.sum()


def rapid_forward(logl: np.ndarray, expected: float, weights: np.ndarray) -> float:
    """Log likelihood of a reset chain with an expected number of resets, by the forward pass alone."""
    if expected <= 0:
        return float(np.logaddexp.reduce(np.log(np.maximum(weights, 5e-324)) + logl.sum(0)))
    n, k = logl.shape
    q = 0.0 if k < 2 or n < 2 else 1 - np.exp(-expected / (n - 1))
    top = logl.max(1, keepdims=True)
    e, at, total = np.exp(logl - top), weights, float(top.sum())
    for t in range(n):
        at = (at if t == 0 else (1 - q) * at + q * weights) * e[t]
        total += float(np.log(at.sum()))
        at = at / at.sum()
    return total


def spread_cuts(positions: np.ndarray, evidence: np.ndarray, sites: int, most: int = 12, least: int = 30) -> np.ndarray:
    """Indexes of at most ``most`` cuts with ``least`` sites on both sides: strongest first, first those that are apart, then by evidence."""
    inside = np.flatnonzero((positions >= least) & (sites - positions >= least))
    ranked = inside[np.lexsort((positions[inside], -evidence[inside]))]
    if len(ranked) <= most:
        return ranked
    first = [int(ranked[k]) for k in suppress(positions[ranked], evidence[ranked], max(least, sites // most), most)]
    return np.array([*first, *[int(k) for k in ranked if k not in set(first)][: most - len(first)]])
