"""Student's t and normal distributions in plain Python, for the few rows that test statistics come in."""

from __future__ import annotations

import math


def beta_regularised(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularised(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + term / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The value that T stays under with probability p, by bisection."""
    if df <= 0:
        return math.nan
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        tail = t_two_sided(mid, df) / 2
        if (1 - tail if mid > 0 else tail) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def mann_whitney_exact(u: float, n: int, m: int) -> float:
    """Two-sided p of U for samples without ties, by counting the arrangements."""
    ways = [[[0] * (n * m + 1) for _ in range(m + 1)] for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                ways[i][j][0] = 1
                continue
            for s in range(i * j + 1):
                ways[i][j][s] = ways[i][j - 1][s] + (ways[i - 1][j][s - j] if s >= j else 0)
    count = ways[n][m]
    top = max(u, n * m - u)
    tail = sum(count[math.ceil(top) :]) / sum(count)
    return min(1.0, 2 * tail)
