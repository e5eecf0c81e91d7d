"""Mixture weights from likelihood tables: EM, Gibbs samplers, variational Dirichlet, optimisers and per-site maxima."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def normal_columns(logl: np.ndarray) -> np.ndarray:
    """[category, site] log likelihoods -> columns that sum to 1."""
    x = np.exp(logl - logl.max(0))
    return x / x.sum(0)


def dirichlet_em(l: np.ndarray, concentration: float = 0.5, steps: int = 2500, tolerance: float = 1e-8) -> np.ndarray:  # noqa: E741
    k, s = l.shape
    theta = np.full(k, 1 / k)
    for _ in range(steps):
        w = theta[:, None] * l
        after = (concentration + (w / w.sum(0)).sum(1)) / (s + concentration * k)
        moved = np.abs(after - theta).max()
        theta = after
        if moved <= tolerance:
            break
    return theta


def gibbs(l: np.ndarray, concentration: float = 0.5, draws: int = 500, burn: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Uncollapsed sampler: (theta mean, allocation counts [category, site]) over the kept draws."""
    rng = np.random.default_rng(seed)
    k, s = l.shape
    theta, mean, counts = np.full(k, 1 / k), np.zeros(k), np.zeros((k, s), np.int64)
    for d in range(draws):
        cum = np.cumsum(theta[:, None] * l, axis=0)
        z = (cum < rng.random(s) * cum[-1]).sum(0)
        theta = rng.dirichlet(concentration + np.bincount(z, minlength=k))
        if d >= burn:
            mean += theta
            counts[z, np.arange(s)] += 1
    return mean / max(1, draws - burn), counts


def gibbs_rejection(l: np.ndarray, concentration: float = 0.5, draws: int = 500, burn: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """The same target: a category drawn from theta is kept with its likelihood over the site's largest; what is left after some tries is drawn exactly."""
    rng = np.random.default_rng(seed)
    k, s = l.shape
    accept = l / l.max(0)
    theta, mean, counts = np.full(k, 1 / k), np.zeros(k), np.zeros((k, s), np.int64)
    for d in range(draws):
        z, open_, cdf = np.zeros(s, np.int64), np.arange(s), np.cumsum(theta)
        for _ in range(20):
            if not len(open_):
                break
            pick = np.minimum(np.searchsorted(cdf, rng.random(len(open_)) * cdf[-1], side="right"), k - 1)
            ok = rng.random(len(open_)) < accept[pick, open_]
            z[open_[ok]] = pick[ok]
            open_ = open_[~ok]
        if len(open_):
            cum = np.cumsum(theta[:, None] * l[:, open_], axis=0)
            z[open_] = (cum < rng.random(len(open_)) * cum[-1]).sum(0)
        theta = rng.dirichlet(concentration + np.bincount(z, minlength=k))
        if d >= burn:
            mean += theta
            counts[z, np.arange(s)] += 1
    return mean / max(1, draws - burn), counts


def gibbs_sparse(l: np.ndarray, cutoff: float = 1e-6, **options) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """The dense sampler on cells at or above a cutoff."""
    kept = np.where(l >= cutoff, l, 0.0)
    if (kept.sum(0) == 0).any():
        raise ValueError("a site has no cell at or above the cutoff")
    return gibbs(kept, **options)


def gibbs_collapsed(l: np.ndarray, concentration: float = 0.5, draws: int = 200, burn: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Theta integrated out; its mean is that of the conditional means (Rao-Blackwell)."""
    rng = np.random.default_rng(seed)
    k, s = l.shape
    z = np.array([rng.choice(k, p=l[:, j] / l[:, j].sum()) for j in range(s)])
    n = np.bincount(z, minlength=k).astype(float)
    mean, counts = np.zeros(k), np.zeros((k, s), np.int64)
    for d in range(draws):
        u = rng.random(s)
        for j in range(s):
            n[z[j]] -= 1
            w = np.cumsum((n + concentration) * l[:, j])
            z[j] = min(k - 1, int(np.searchsorted(w, u[j] * w[-1])))
            n[z[j]] += 1
        if d >= burn:
            mean += (n + concentration) / (s + concentration * k)
            counts[z, np.arange(s)] += 1
    return mean / max(1, draws - burn), counts


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def sparse_dirichlet(l: np.ndarray, concentration: float = 0.1, steps: int = 200, least: float = 0.5) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Variational weights exp(psi(a)); categories whose expected count stays below ``least`` are dropped. (kept, theta)."""
    kept = np.arange(len(l))
    while True:
        x = l[kept]
        n = np.full(len(kept), l.shape[1] / len(kept))
        for _ in range(steps):
            w = np.exp([digamma(v) for v in n + concentration])[:, None] * x
            after = (w / np.maximum(w.sum(0), 1e-300)).sum(1)
            if np.abs(after - n).max() < 1e-6:
                n = after
                break
            n = after
        weak = n < least
        if not weak.any() or len(kept) == 1:
            return kept, (n + concentration) / (n + concentration).sum()
        kept = kept[~weak] if (~weak).any() else kept[[int(n.argmax())]]


def golden(f, low: float, high: float, tolerance: float = 1e-6) -> tuple[float, float]:
    """Maximiser of a one-dimensional function in a bracket, and its value."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc >= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    x = (a + b) / 2
    return x, f(x)


def nelder_mead(f, x0: np.ndarray, step: float = 0.3, steps: int = 90, bound: float = 5.0) -> tuple[np.ndarray, float]:
    """Maximum by a simplex; coordinates are held within the bound."""
    clip = lambda x: np.clip(x, -bound, bound)
    points = [clip(np.asarray(x0, float))] + [clip(x0 + step * np.eye(len(x0))[k]) for k in range(len(x0))]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)[::-1]
        points, values = [points[k] for k in order], [values[k] for k in order]
        mid = np.mean(points[:-1], axis=0)
        up = clip(mid + (mid - points[-1]))
        v = f(up)
        if v > values[0]:
            far = clip(mid + 2 * (mid - points[-1]))
            w = f(far)
            points[-1], values[-1] = (far, w) if w > v else (up, v)
        elif v > values[-2]:
            points[-1], values[-1] = up, v
        else:
            near = clip(mid + 0.5 * ((up if v > values[-1] else points[-1]) - mid))
            w = f(near)
            if w > max(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [(points[0] + p) / 2 for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    k = int(np.argmax(values))
    return points[k], values[k]


def lbfgs(f, x0: np.ndarray, steps: int = 60, memory: int = 7, tolerance: float = 1e-6, h: float = 2e-4, gradient=None) -> tuple[np.ndarray, float]:
    """Maximum by limited-memory quasi-Newton with Armijo steps; without a gradient it uses forward differences."""

    def slope(x: np.ndarray, v: float) -> np.ndarray:
        if gradient is not None:
            return gradient(x)
        return np.array([(f(x + h * e) - v) / h for e in np.eye(len(x))])

    x, held = np.asarray(x0, float), []
    v = f(x)
    g = slope(x, v)
    for _ in range(steps):
        if np.abs(g).max() < tolerance:
            break
        q, alphas = g.copy(), []
        for s, y, r in reversed(held):
            a = r * (s @ q)
            alphas.append(a)
            q = q - a * y
        if held:
            s, y, _ = held[-1]
            q = q * (s @ y) / (y @ y)
        for (s, y, r), a in zip(held, reversed(alphas), strict=True):
            q = q + s * (a - r * (y @ q))
        d = q if q @ g > 0 else g
        t = 1.0 if held else min(1.0, 1.0 / np.abs(d).max())
        while t > 1e-10 and not (w := f(x + t * d)) >= v + 1e-4 * t * (g @ d):
            t /= 2
        if t <= 1e-10:
            break
        after = slope(x + t * d, w)
        s, y = t * d, g - after  # of the negated function
        if s @ y > 1e-12:
            held = [*held[-(memory - 1):], (s, y, 1 / (s @ y))]
        done = abs(w - v) < tolerance * (1 + abs(v))
        x, v, g = x + t * d, w, after
        if done:
            break
    return x, v


def stencil_search(f, start: tuple[float, float], span: float = 1.0, rounds: int = 8) -> tuple[tuple[float, float], float]:
    """Maximum of f(a, b) over positive a, b by shrinking 3 x 3 steps on log scales."""
    at, best = start, f(*start)
    for _ in range(rounds):
        found = max(((f(at[0] * math.exp(i * span), at[1] * math.exp(j * span)), i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
        if found[0] > best:
            best, at = found[0], (at[0] * math.exp(found[1] * span), at[1] * math.exp(found[2] * span))
        else:
            span /= 2
    return at, best


class Bicubic:
    """Interpolates a table exactly at its nodes by cubic Hermite pieces along both axes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray):
        self.x, self.y, self.z = x, y, z

    @staticmethod
    def _along(x: np.ndarray, v: np.ndarray, at: float) -> np.ndarray:
        k = int(np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 2))
        h = x[k + 1] - x[k]
        slope = np.gradient(v, x, axis=0)
        t = (np.clip(at, x[0], x[-1]) - x[k]) / h
        return (1 + 2 * t) * (1 - t) ** 2 * v[k] + t * (1 - t) ** 2 * h * slope[k] + t * t * (3 - 2 * t) * v[k + 1] + t * t * (t - 1) * h * slope[k + 1]

    def __call__(self, a: float, b: float) -> float:
        return float(self._along(self.y, self._along(self.x, self.z, a), b))


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shape-preserving cubic interpolation, constant beyond the ends."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    for k in range(1, len(x) - 1):
        if d[k - 1] * d[k] > 0:
            w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            m[k] = (w1 + w2) / (w1 / d[k - 1] + w2 / d[k])
    m[0], m[-1] = d[0], d[-1]
    at = np.clip(at, x[0], x[-1])
    k = np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 2)
    t = (at - x[k]) / h[k]
    return (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * m[k] + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * h[k] * m[k + 1]


def approximate_fel(logl: np.ndarray, alphas: np.ndarray, betas: np.ndarray) -> dict[str, float]:
    """One site's likelihood ratio from its surface [alpha, beta]: best of the plane against best of the diagonal alpha = beta."""
    surface = Bicubic(np.arange(len(alphas), dtype=float), np.arange(len(betas), dtype=float), logl)
    i, j = np.unravel_index(int(logl.argmax()), logl.shape)
    a, b = float(i), float(j)
    best = surface(a, b)
    for _ in range(4):
        a, _ = golden(lambda v: surface(v, b), max(0, a - 1), min(len(alphas) - 1, a + 1), 1e-3)  # noqa: B023
        b, now = golden(lambda v: surface(a, v), max(0, b - 1), min(len(betas) - 1, b + 1), 1e-3)  # noqa: B023
        if now - best < 1e-6:
            best = max(best, now)
            break
        best = now
    n = min(len(alphas), len(betas)) - 1
    start = max(range(n + 1), key=lambda k: logl[k, k])
    _, null = golden(lambda v: surface(v, v), max(0, start - 1), min(n, start + 1), 1e-3)
    alpha, beta = float(np.interp(a, np.arange(len(alphas)), alphas)), float(np.interp(b, np.arange(len(betas)), betas))
    lrt = max(0.0, 2 * (best - null))
    return {"lrt": lrt, "alpha": alpha, "beta": beta, "logl": best, "logl_null": null, "direction": 0 if lrt == 0 else (1 if beta > alpha else -1)}


def _goldens(f: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """``golden`` of many functions at once, each with its bracket."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = low.copy(), high.copy()
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    while (on := b - a > tolerance).any():
        left, right = on & (fc >= fd), on & ~(fc >= fd)
        b, a = np.where(left, d, b), np.where(right, c, a)
        at = np.where(left, b - ratio * (b - a), a + ratio * (b - a))
        value = f(at)
        c, d, fc, fd = np.where(left, at, np.where(right, d, c)), np.where(right, at, np.where(left, c, d)), np.where(left, value, np.where(right, fd, fc)), np.where(right, value, np.where(left, fc, fd))
    x = (a + b) / 2
    return x, f(x)


def approximate_fels(logl: np.ndarray, alphas: np.ndarray, betas: np.ndarray) -> dict[str, np.ndarray]:
    """``approximate_fel`` of many sites [site, alpha, beta], all searched together."""
    sites, (na, nb) = np.arange(len(logl)), logl.shape[1:]
    slopes = np.gradient(logl, axis=1)

    def pieces(at: np.ndarray, n: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        k = np.clip(np.ceil(at).astype(int) - 1, 0, n - 2)
        t = np.clip(at, 0, n - 1) - k
        return k, ((1 + 2 * t) * (1 - t) ** 2, t * (1 - t) ** 2, t * t * (3 - 2 * t), t * t * (t - 1))

    def surface(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k, w = pieces(a, na)
        w0, w1, w2, w3 = (x[:, None] for x in w)
        row = w0 * logl[sites, k] + w1 * slopes[sites, k] + w2 * logl[sites, k + 1] + w3 * slopes[sites, k + 1]
        slope = np.gradient(row, axis=1)
        k, (w0, w1, w2, w3) = pieces(b, nb)
        return w0 * row[sites, k] + w1 * slope[sites, k] + w2 * row[sites, k + 1] + w3 * slope[sites, k + 1]

    i, j = np.unravel_index(logl.reshape(len(logl), -1).argmax(1), (na, nb))
    a, b = i.astype(float), j.astype(float)
    best, on = surface(a, b), np.ones(len(logl), bool)
    for _ in range(4):
        x, _ = _goldens(lambda v: surface(v, b), np.maximum(0, a - 1), np.minimum(na - 1, a + 1), 1e-3)  # noqa: B023
        a = np.where(on, x, a)
        x, now = _goldens(lambda v: surface(a, v), np.maximum(0, b - 1), np.minimum(nb - 1, b + 1), 1e-3)  # noqa: B023
        b = np.where(on, x, b)
        settled = now - best < 1e-6
        best = np.where(on, np.where(settled, np.maximum(best, now), now), best)
        on &= ~settled
        if not on.any():
            break
    n = min(na, nb) - 1
    start = logl[:, np.arange(n + 1), np.arange(n + 1)].argmax(1).astype(float)
    _, null = _goldens(lambda v: surface(v, v), np.maximum(0, start - 1), np.minimum(n, start + 1), 1e-3)
    alpha, beta = np.interp(a, np.arange(na), alphas), np.interp(b, np.arange(nb), betas)
    lrt = np.maximum(0.0, 2 * (best - null))
    return {"lrt": lrt, "alpha": alpha, "beta": beta, "logl": best, "logl_null": null, "direction": np.where(lrt == 0, 0, np.where(beta > alpha, 1, -1))}


def log_gamma(x: float) -> float:
    return math.lgamma(x)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        for _ in range(1000):
            k += 1
            term *= x / k
            total += term
            if term < total * 1e-16:
                break
        return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for k in range(1, 1000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return max(0.0, 1 - h * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def gamma_quantile(p: float, shape: float, mean: float = 1.0) -> float:
    """By bisection of the logarithm."""
    if p <= 0:
        return 0.0
    low, high = -700.0, math.log(shape + 40 * math.sqrt(shape) + 100)
    for _ in range(120):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(shape, math.exp(mid)) < p else (low, mid)
    return math.exp((low + high) / 2) * mean / shape


def gamma_ps(a: float, x: np.ndarray) -> np.ndarray:
    """``gamma_p`` of many points of one shape; a point leaves once its series or fraction has settled."""
    x = np.asarray(x, float)
    out, low = np.zeros(len(x)), (x > 0) & (x < a + 1)
    with np.errstate(divide="ignore"):
        front = np.exp(-x + a * np.log(x) - math.lgamma(a))
    at = np.flatnonzero(low)
    term, total, k = np.full(len(at), 1 / a), np.full(len(at), 1 / a), a
    for _ in range(1000):
        if not len(at):
            break
        k += 1
        term = term * (x[at] / k)
        total = total + term
        done = term < total * 1e-16
        out[at[done]] = np.minimum(1.0, total[done] * front[at[done]])
        at, term, total = at[~done], term[~done], total[~done]
    out[at] = np.minimum(1.0, total * front[at])
    at = np.flatnonzero(x >= a + 1)
    b = x[at] + 1 - a
    c, d = np.full(len(at), 1e300), 1 / b
    h = d.copy()
    for k in range(1, 1000):
        if not len(at):
            break
        an = -k * (k - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(d == 0, 1e-300, d)
        c = b + an / c
        c = np.where(c == 0, 1e-300, c)
        h = h * (d * c)
        done = np.abs(d * c - 1) < 1e-15
        out[at[done]] = np.maximum(0.0, 1 - h[done] * front[at[done]])
        at, b, c, d, h = (v[~done] for v in (at, b, c, d, h))
    out[at] = np.maximum(0.0, 1 - h * front[at])
    return out


def gamma_quantiles(p: np.ndarray, shape: float) -> np.ndarray:
    """``gamma_quantile`` of many shares of one shape and mean ``shape``: by bisection of all at once, until no number lies between."""
    p = np.asarray(p, float)
    low, high = np.full(len(p), -700.0), np.full(len(p), math.log(shape + 40 * math.sqrt(shape) + 100))
    for _ in range(64):
        mid = (low + high) / 2
        below = gamma_ps(shape, np.exp(mid)) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where(p <= 0, 0.0, np.exp((low + high) / 2))


def gamma_slices(n: int, shape: float, mean: float = 1.0, by: str = "mean") -> list[float]:
    """n equally likely rates: at mid-quantiles (scaled to the mean), or conditional means of the slices."""
    if by == "median":
        raw = [gamma_quantile((i + 0.5) / n, shape) for i in range(n)]
        return [v * mean * n / sum(raw) for v in raw]
    edges = [gamma_quantile(i / n, shape) * shape for i in range(n)]
    tails = [gamma_p(shape + 1, e) for e in edges] + [1.0]
    return [mean * n * (b - a) for a, b in zip(tails, tails[1:], strict=False)]


def split_slices(n: int, shape: float, mean: float, threshold: float = 1.0) -> list[tuple[float, float]]:
    """(rate, weight) with separate slices on each side of a threshold, by exact masses."""
    below = gamma_p(shape, threshold * shape / mean)
    out = []
    for low, high, m in ((0.0, below, max(1, n // 2)), (below, 1.0, max(1, n - n // 2))):
        for i in range(m):
            a, b = low + (high - low) * i / m, low + (high - low) * (i + 1) / m
            if b - a > 1e-12:
                xa, xb = (gamma_quantile(q, shape) * shape if q < 1 else math.inf for q in (a, b))
                mass = (1.0 if xb == math.inf else gamma_p(shape + 1, xb)) - gamma_p(shape + 1, xa)
                out.append((mean * mass / (b - a), b - a))
    return out
