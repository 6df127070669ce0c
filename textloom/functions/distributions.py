"""Tails of the F and t distributions by the regularised incomplete beta function; driver-side, plain Python."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, cc, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + step * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        cc = 1.0 + step / cc
        cc = cc if abs(cc) > tiny else tiny
        f *= cc * d
        if abs(1.0 - cc * d) < 1e-15:
            break
    return front * (f - 1.0)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    if not f > 0:
        return 1.0
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))
