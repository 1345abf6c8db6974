"""Distribution functions for test statistics, on single numbers.

A test's heavy part is an aggregation in Spark; what reaches the driver is one
statistic, and its p-value is computed here.
"""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _gamma_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def chi2_upper(x: float, df: float) -> float:
    return 1 - _gamma_lower(df / 2, x / 2)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 10_000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or 1e-300)
            c = 1 + n / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_upper(x: float, d1: float, d2: float) -> float:
    return 1 - _beta(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return _beta(df / 2, 0.5, df / (df + t * t))


def studentized_range_upper(q: float, k: int, steps: int = 4000) -> float:
    """P(range of k standard normals > q), infinite degrees of freedom."""
    if q <= 0:
        return 1.0
    normal, h, total = NormalDist(), 16 / steps, 0.0
    for i in range(steps + 1):
        z = -8 + i * h
        total += (0.5 if i in (0, steps) else 1) * normal.pdf(z) * (normal.cdf(z + q) - normal.cdf(z)) ** (k - 1)
    return max(0.0, 1 - k * total * h)


def studentized_range_quantile(alpha: float, k: int) -> float:
    low, high = 0.0, 50.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if studentized_range_upper(mid, k, 1000) > alpha else (low, mid)
    return (low + high) / 2
