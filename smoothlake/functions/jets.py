"""Second-order jets: arrays that carry their first and second derivatives in a few variables.

A jet over k variables is a value with k first and k (k + 1) / 2 second derivatives, each an array over rows. Sums,
products and functions of jets follow the chain rule exactly, so a likelihood written once with them gives its
gradient and Hessian to rounding. Derivatives that are zero everywhere are held as the number 0.0.
"""

from __future__ import annotations

import numpy as np

from smoothlake.functions.special import digamma, expit, lgamma, log1pexp, trigamma


def pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i + 1)]


class Jet:
    __array_ufunc__ = None  # arrays leave operations with jets to the jets

    def __init__(self, v, g: list, h: list):
        self.v, self.g, self.h = v, g, h

    @classmethod
    def variables(cls, values: list[np.ndarray]) -> list[Jet]:
        k = len(values)
        return [cls(np.asarray(v, float), [1.0 if i == at else 0.0 for i in range(k)], [0.0] * (k * (k + 1) // 2)) for at, v in enumerate(values)]

    def _map(self, f0, f1, f2) -> Jet:
        """f(self), from f and its derivatives at the value."""
        k = len(self.g)
        return Jet(f0, [_times(f1, a) for a in self.g], [_plus(_times(f1, c), _times(f2, _times(self.g[i], self.g[j]))) for (i, j), c in zip(pairs(k), self.h, strict=True)])

    def __neg__(self) -> Jet:
        return Jet(-self.v, [-a for a in self.g], [-c for c in self.h])

    def __add__(self, o) -> Jet:
        if not isinstance(o, Jet):
            return Jet(self.v + o, self.g, self.h)
        return Jet(self.v + o.v, [_plus(a, b) for a, b in zip(self.g, o.g, strict=True)], [_plus(a, b) for a, b in zip(self.h, o.h, strict=True)])

    __radd__ = __add__

    def __sub__(self, o) -> Jet:
        return self + (-o)

    def __rsub__(self, o) -> Jet:
        return (-self) + o

    def __mul__(self, o) -> Jet:
        if not isinstance(o, Jet):
            return Jet(self.v * o, [_times(o, a) for a in self.g], [_times(o, c) for c in self.h])
        k = len(self.g)
        g = [_plus(_times(self.v, b), _times(o.v, a)) for a, b in zip(self.g, o.g, strict=True)]
        h = [
            _plus(_plus(_times(self.v, d), _times(o.v, c)), _plus(_times(self.g[i], o.g[j]), _times(self.g[j], o.g[i])))
            for (i, j), c, d in zip(pairs(k), self.h, o.h, strict=True)
        ]
        return Jet(self.v * o.v, g, h)

    __rmul__ = __mul__

    def __truediv__(self, o) -> Jet:
        return self * (reciprocal(o) if isinstance(o, Jet) else 1 / o)

    def __rtruediv__(self, o) -> Jet:
        return reciprocal(self) * o

    def __pow__(self, n: float) -> Jet:
        v = self.v
        return self._map(v**n, n * v ** (n - 1), n * (n - 1) * v ** (n - 2))

    def parts(self) -> tuple[np.ndarray, list[np.ndarray], list[list[np.ndarray]]]:
        """(value, gradient, Hessian as rows), every one an array over rows."""
        k = len(self.g)
        full = lambda x: np.broadcast_to(np.asarray(x, float), np.shape(self.v))
        h = [[None] * k for _ in range(k)]
        for (i, j), c in zip(pairs(k), self.h, strict=True):
            h[i][j] = h[j][i] = full(c)
        return self.v, [full(a) for a in self.g], h


def _nothing(x) -> bool:
    return isinstance(x, float) and x == 0.0


def _times(a, b):
    return 0.0 if _nothing(a) or _nothing(b) else a * b


def _plus(a, b):
    return b if _nothing(a) else a if _nothing(b) else a + b


def value(x):
    return x.v if isinstance(x, Jet) else x


def reciprocal(x: Jet) -> Jet:
    r = 1 / x.v
    return x._map(r, -r * r, 2 * r**3)


def _of(plain, first, second):
    """A function of arrays and of jets, from its value and derivatives; each is given the argument and the value."""

    def f(x):
        if not isinstance(x, Jet):
            return plain(x)
        v = plain(x.v)
        return x._map(v, first(x.v, v), second(x.v, v))

    return f


exp = _of(np.exp, lambda x, v: v, lambda x, v: v)
log = _of(np.log, lambda x, v: 1 / x, lambda x, v: -1 / x**2)
log1p = _of(np.log1p, lambda x, v: 1 / (1 + x), lambda x, v: -1 / (1 + x) ** 2)
expm1 = _of(np.expm1, lambda x, v: v + 1, lambda x, v: v + 1)
logistic = _of(expit, lambda x, v: v * (1 - v), lambda x, v: v * (1 - v) * (1 - 2 * v))
softplus = _of(log1pexp, lambda x, v: expit(x), lambda x, v: expit(x) * expit(-x))
log_gamma = _of(lgamma, lambda x, v: digamma(x), lambda x, v: trigamma(x))


def apply_link(link, eta):
    """A link's inverse, of an array or a jet."""
    return eta._map(link.inv(eta.v), link.d1(eta.v), link.d2(eta.v)) if isinstance(eta, Jet) else link.inv(eta)


def _log1p_ratio_parts(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log(1 + u) / u with its first two derivatives; near zero by the series, where the quotients cancel."""
    small = np.abs(u) < 1e-2
    s = np.where(small, 1.0, u)
    with np.errstate(all="ignore"):
        q = np.log1p(s) / s
        d1 = (1 / (1 + s) - q) / s
        d2 = (-1 / (1 + s) ** 2 - 2 * d1) / s
    if np.any(small):
        x = np.where(small, u, 0.0)
        a = [(-1.0) ** n / (n + 1) for n in range(14)]
        series = lambda c: sum(k * x**n for n, k in enumerate(c))
        q = np.where(small, series(a), q)
        d1 = np.where(small, series([n * k for n, k in enumerate(a)][1:]), d1)
        d2 = np.where(small, series([n * (n - 1) * k for n, k in enumerate(a)][2:]), d2)
    return q, d1, d2


def log1p_ratio(u):
    """log(1 + u) / u, smooth through u = 0: what shapes that may vanish divide by."""
    parts = _log1p_ratio_parts(np.asarray(value(u), float))
    return u._map(*parts) if isinstance(u, Jet) else parts[0]


def where(condition: np.ndarray, a, b):
    """Row by row one of two jets (or arrays)."""
    if not isinstance(a, Jet) and not isinstance(b, Jet):
        return np.where(condition, a, b)
    k = len((a if isinstance(a, Jet) else b).g)
    part = lambda x, name, at: (getattr(x, name)[at] if isinstance(x, Jet) else 0.0)
    pick = lambda x, y: 0.0 if _nothing(x) and _nothing(y) else np.where(condition, x, y)
    return Jet(np.where(condition, value(a), value(b)), [pick(part(a, "g", i), part(b, "g", i)) for i in range(k)], [pick(part(a, "h", i), part(b, "h", i)) for i in range(k * (k + 1) // 2)])
