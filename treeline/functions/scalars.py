"""Scalar expressions: guarded logs and ratios, tails of distributions, distances and criteria."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rational-exponential approximation of erfc for t = 1 / (1 + |x| / 2), lowest power first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def guarded_ratio(n: Column, d: Column) -> Column:
    """n / d, null unless n >= 0 and d > 0."""
    return F.when((n >= 0) & (d > 0), n / d)


def guarded_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log_add(a: Column, b: Column) -> Column:
    """log(e^a + e^b); minus infinity and null count as nothing."""
    none = F.lit(float("-inf"))
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    top = F.greatest(a, b)
    return F.when(top == none, none).otherwise(top + F.log1p(F.exp(-F.abs(a - b))))


def log1mexp(x: Column) -> Column:
    """log(1 - e^x) for x < 0, by the form that is exact on either side of -ln 2."""
    return F.when(x > -math.log(2), F.ln(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def logistic(x: Column, most: float = 700.0) -> Column:
    x = F.greatest(F.least(x, F.lit(most)), F.lit(-most))
    return 1 / (1 + F.exp(-x))


def exp_ratio(x: Column) -> Column:
    """e^x, infinite above 709 and 0 below -745."""
    return F.when(x > 709, F.lit(float("inf"))).when(x < -745, F.lit(0.0)).otherwise(F.exp(x))


def bayes_factor(posterior: Column, prior: Column) -> Column:
    """Posterior odds over prior odds; infinite if the posterior is 1, 0 if it is 0, null without prior odds."""
    ok = (prior > 0) & (prior < 1)
    odds = (posterior / F.nullif(1 - posterior, F.lit(0.0))) / (prior / F.nullif(1 - prior, F.lit(0.0)))
    return F.when(~ok, None).when(posterior >= 1, F.lit(float("inf"))).when(posterior <= 0, F.lit(0.0)).otherwise(odds)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + c
    tail = t * F.exp(-z * z + poly)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def chi2_tail_1(x: Column) -> Column:
    return F.when(x <= 0, F.lit(1.0)).otherwise(erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2)))


def chi2_tail_2(x: Column) -> Column:
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.exp(-x / 2))


def branch_test_p(lrt: Column) -> Column:
    """Mixture tail 0.5, 0.05 and 0.45 of 0, 1 and 2 degrees of freedom; 0.5 at or below zero."""
    return F.when(lrt <= 0, F.lit(0.5)).otherwise(F.least(F.lit(0.5), 0.05 * chi2_tail_1(lrt) + 0.45 * chi2_tail_2(lrt)))


def one_sided(lrt: Column, direction: Column) -> tuple[Column, Column]:
    """(p positive, p purifying) from a likelihood ratio and its sign."""
    half = chi2_tail_1(lrt) / 2
    positive = F.when((lrt <= 0) | (direction == 0), F.lit(0.5)).when(direction > 0, half).otherwise(1 - half)
    return positive, 1 - positive


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def g_statistic(left: list[Column], right: list[Column]) -> Column:
    """2 x k likelihood-ratio statistic of two rows of counts."""
    columns = sum((xlogx((a + b).cast("double")) for a, b in zip(left, right, strict=True)), F.lit(0.0))
    cells = sum((xlogx(c.cast("double")) for c in (*left, *right)), F.lit(0.0))
    total_left, total_right = sum(left[1:], left[0]), sum(right[1:], right[0])
    whole = xlogx((total_left + total_right).cast("double"))
    rows = xlogx(total_left.cast("double")) + xlogx(total_right.cast("double"))
    return 2 * (cells - columns - rows + whole)


def information_criterion(kind: str, logl: Column, k: Column, n: Column) -> Column:
    """aic, aicc (infinite unless n - k - 1 > 0) or bic."""
    aic = 2 * k - 2 * logl
    if kind == "aic":
        return aic
    if kind == "bic":
        return k * F.ln(n) - 2 * logl
    return F.when(n - k - 1 > 0, aic + 2 * k * (k + 1) / F.nullif(n - k - 1, F.lit(0))).otherwise(F.lit(float("inf")))


def jukes_cantor(mismatches: Column, compared: Column) -> Column:
    """Distance with p clipped at 0.74; 1 without data."""
    p = F.least(mismatches / F.nullif(compared, F.lit(0)), F.lit(0.74))
    return F.when(compared > 0, -0.75 * F.ln(1 - 4 * p / 3)).otherwise(F.lit(1.0))


def jukes_cantor_open(mismatches: Column, compared: Column) -> Column:
    """The other convention: 0 without data, infinite from p = 3/4 on."""
    p = mismatches / F.nullif(compared, F.lit(0))
    return F.when(compared <= 0, F.lit(0.0)).when(p >= 0.75, F.lit(float("inf"))).otherwise(-0.75 * F.ln(1 - 4 * F.least(p, F.lit(0.7499999)) / 3))


def fixation_rate(delta: Column) -> Column:
    """delta / (1 - e^-delta), by series near zero and by its tails."""
    near = 1 + delta / 2 + delta * delta / 12
    return F.when(F.abs(delta) < 1e-5, near).when(delta > 50, delta).when(delta < -50, -delta * F.exp(F.greatest(delta, F.lit(-740.0)))).otherwise(-delta / F.expm1(-delta))


def safe_name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def csv_cell(x: Column) -> Column:
    s = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(s.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def newick_name(x: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))


def camel_label(x: Column) -> Column:
    words = F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def insertion_suffix(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA: bijective base 26, for up to four letters."""
    out, rest = F.lit(""), n.cast("long")
    for _ in range(4):
        letter = F.char(65 + F.pmod(rest - 1, F.lit(26)))
        out = F.when(rest > 0, F.concat(letter, out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0))
    return out


def intensity(omega: Column, k: Column, most: float = 10.0) -> Column:
    """sign(ln w) min(k |ln w|, most), back as a rate."""
    return F.exp(F.signum(F.ln(omega)) * F.least(k * F.abs(F.ln(omega)), F.lit(most)))


def combination_rank(a: Column, b: Column, c: Column, n: Column) -> Column:
    """Place of a < b < c (from 0) among the triplets of n in lexicographic order."""
    a, b, c, n = (x.cast("long") for x in (a, b, c, n))  # the cube of 1,291 is no int

    def three(m: Column) -> Column:
        return F.call_function("div", m * (m - 1) * (m - 2), F.lit(6))

    def two(m: Column) -> Column:
        return F.call_function("div", m * (m - 1), F.lit(2))

    return (three(n) - three(n - a) + two(n - a - 1) - two(n - b) + (c - b - 1)).cast("long")


def third_taxon(a: Column, b: Column, n: int) -> Column:
    """A deterministic third taxon for a pair, by a 32-bit multiplicative hash."""
    h = F.pmod((a.cast("long") + 1) * F.lit(73856093) + (b.cast("long") + 1) * F.lit(19349663), F.lit(1 << 32))
    h = F.pmod(h * F.lit(69069) + F.lit(1), F.lit(1 << 32))
    return F.pmod(h, F.lit(n)).cast("int")


def signal_strength(excess: Column, credibility: Column, most: float = 50.0) -> Column:
    return F.log1p(F.greatest(F.least(excess, F.lit(most)), F.lit(0.0))) * credibility


def minimum_span(requested: Column, target: Column, variable_fraction: Column, sites: Column) -> Column:
    """max(60, requested, target / variable fraction), at most half of the sites."""
    need = F.coalesce(F.ceil(target / F.nullif(variable_fraction, F.lit(0.0))), F.lit(0))
    return F.least(F.greatest(F.lit(60), requested, need), F.floor(sites / 2)).cast("long")


def decode_branch(raw: list[Column], longest: float = 20.0) -> dict[str, Column]:
    """Unbounded values -> ordered rates w1 <= w2 <= 1 < w3, weights by softmax, and a bounded length."""
    w2 = 1 / (1 + F.exp(-raw[1]))
    w1 = w2 / (1 + F.exp(-raw[0]))
    a, b = F.exp(raw[3]), F.exp(raw[4])
    return {"w1": w1, "w2": w2, "w3": 1 + F.exp(raw[2]), "p1": a / (1 + a + b), "p2": b / (1 + a + b), "p3": 1 / (1 + a + b), "length": F.least(F.exp(raw[5]), F.lit(longest))}
