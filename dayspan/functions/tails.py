"""Tail probabilities of single test statistics, evaluated on the driver.

Inputs are a handful of numbers (one per feature or pair of clusters), never data rows.
"""

from __future__ import annotations

import math


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        m2 = 2 * m
        for num in (
            m * (b - m) * x / ((a + m2 - 1) * (a + m2)),
            -(a + m) * (a + b + m) * x / ((a + m2) * (a + m2 + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t; beyond ten million degrees of freedom it is the normal."""
    if df > 1e7:
        return math.erfc(abs(t) / math.sqrt(2.0))
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile: t with P(T > t) = p, for p < 0.5."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) / 2.0 > p:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if t_two_sided(mid, df) / 2.0 > p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def chi2_tail(x: float, df: float) -> float:
    """P(X >= x) for chi-squared."""
    a, x = df / 2.0, x / 2.0
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * front
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h


def ks_tail(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov statistic."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 1e-9:
        return 1.0
    if x < 1.18:  # series that converges for small arguments
        y = math.exp(-(math.pi**2) / (8 * x * x))
        return 1.0 - math.sqrt(2 * math.pi) / x * (y + y**9 + y**25 + y**49)
    return min(1.0, 2.0 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))


def grubbs_critical(n: int, alpha: float) -> float:
    """Two-sided Grubbs limit for the largest deviation in units of the sample SD."""
    t = t_quantile(alpha / (2 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))
