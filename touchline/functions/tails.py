"""Tail probabilities and quantiles of a few distributions, for single numbers on the driver."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    """P(|Z| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi_square_upper(x: float, df: float) -> float:
    """P(chi-square with df degrees of freedom > x)."""
    if math.isnan(x) or df <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    return _gamma_upper(df / 2.0, x / 2.0)


def _gamma_upper(a: float, x: float) -> float:
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        # power series of the lower part
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    # continued fraction of the upper part
    return front * _fraction(x + 1.0 - a, lambda i: (-i * (i - a), x + 1.0 - a + 2.0 * i))


def _fraction(b0: float, step, limit: int = 10_000) -> float:
    """1 / (b0 + a1/(b1 + a2/(b2 + ...))), evaluated forward by successive ratios."""
    tiny = 1e-300
    c, d = 1.0 / tiny, 1.0 / (b0 or tiny)
    value = d
    for i in range(1, limit):
        a, b = step(i)
        d = 1.0 / ((a * d + b) or tiny)
        c = (b + a / c) or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return value


def beta_lower(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_lower(1.0 - x, b, a)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    return math.exp(log_front) / a * _fraction(1.0, step)


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if beta_lower(mid, a, b) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def exact_binomial_interval(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Interval for a proportion from the exact binomial tails."""
    tail = (1.0 - level) / 2.0
    low = 0.0 if hits == 0 else beta_quantile(tail, hits, n - hits + 1)
    high = 1.0 if hits == n else beta_quantile(1.0 - tail, hits + 1, n - hits)
    return low, high


def binomial_upper(hits: int, n: int, p: float) -> float:
    """P(X >= hits) for X binomial(n, p)."""
    return 1.0 if hits <= 0 else beta_lower(p, hits, n - hits + 1)


Z95 = 1.959963984540054
CHI2_95_1DF = 3.841458820694124
