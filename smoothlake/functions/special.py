"""Special functions on arrays and tail probabilities, in NumPy alone."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.frompyfunc(math.erfc, 1, 1)


def lgamma(x):
    """log Gamma for positive x: recurrence up to 8, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    r = 1 / y
    s = r * (1 / 12 - r * r * (1 / 360 - r * r * (1 / 1260 - r * r * (1 / 1680 - r * r / 1188))))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + s - shift


def digamma(x):
    x = np.asarray(x, float)
    out, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        out = np.where(low, out - 1 / np.where(low, y, 1.0), out)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    return out + np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x):
    x = np.asarray(x, float)
    out, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        out = np.where(low, out + 1 / np.where(low, y * y, 1.0), out)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    return out + 1 / y + r / 2 + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def log1pexp(x):
    x = np.asarray(x, float)
    return np.where(x > 0, x, 0) + np.log1p(np.exp(-np.abs(x)))


def expit(x):
    x = np.asarray(x, float)
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


softplus = log1pexp


def softplus_d1(x):
    return expit(x)


def softplus_d2(x):
    s = expit(x)
    return s * (1 - s)


def softplus_d3(x):
    s = expit(x)
    return s * (1 - s) * (1 - 2 * s)


def normal_cdf(x):
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def normal_pdf(x):
    x = np.asarray(x, float)
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def normal_ppf(p):
    """Quantile: a start from the logistic approximation, then Halley steps on the distribution function."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    tail = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(tail))
    x = t - (2.30753 + 0.27061 * t) / (1 + t * (0.99229 + 0.04481 * t))
    x = -x  # quantile of the lower tail
    for _ in range(3):
        d = normal_pdf(x)
        e = (normal_cdf(x) - tail) / np.maximum(d, 1e-300)
        x = x - e / (1 + np.clip(x * e / 2, -0.5, 0.5))
    return np.where(p < 0.5, x, -x)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(10_000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / (c if abs(c) > 1e-300 else 1e-300)
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if x <= 0 else max(0.0, 1 - gamma_p(df / 2, x / 2))


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_i(df / 2, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        cdf = 1 - t_sf2(mid, df) / 2 if mid > 0 else t_sf2(mid, df) / 2
        lo, hi = (mid, hi) if cdf < p else (lo, mid)
    return (lo + hi) / 2


def binomial_cdf(k: int, n: int, p: float) -> float:
    return 1.0 if k >= n else 0.0 if k < 0 else beta_i(n - k, k + 1, 1 - p)


def binomial_ppf(q: float, n: int, p: float) -> int:
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi) // 2
        if binomial_cdf(mid, n, p) >= q:
            hi = mid
        else:
            lo = mid + 1
    return lo
