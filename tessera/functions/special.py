"""Distribution functions that neither Spark nor numpy has."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by its continued fraction (modified Lentz method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 400):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + up / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_test_p(r2: float | None, n: int) -> float:
    """Two-sided p of a simple regression's slope; 1 where there is nothing to test."""
    if r2 is None or n < 3 or r2 != r2:
        return 1.0
    if r2 >= 1:
        return 0.0
    df = n - 2
    t2 = r2 * df / (1 - r2)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))
