"""Smooth bases. Each knows its raw columns for a block of rows, its penalties and its null space, and holds
nothing of the size of the data: it is built from ranges, quantiles, levels or a bounded set of points, and is
shipped to the tasks as it is."""

from __future__ import annotations

import math

import numpy as np

from smoothlake.plans.formula import SHAPES, SmoothSpec

MOST_KNOTS = 2000  # points a kernel basis is eigen-decomposed on


def difference(k: int, order: int) -> np.ndarray:
    return np.diff(np.eye(k), order, axis=0)


def null_basis(c: np.ndarray) -> np.ndarray:
    """Orthonormal columns Z with c Z = 0, for the rows of ``c``."""
    q, _ = np.linalg.qr(np.atleast_2d(c).T, mode="complete")
    return q[:, np.atleast_2d(c).shape[0] :]


def bsplines(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """Values of all B-splines; zero beyond the outermost knots."""
    x = np.asarray(x, float)[:, None]
    t = knots
    b = ((t[:-1] <= x) & (x < t[1:])).astype(float)
    for d in range(1, degree + 1):
        left, right = t[d:-1] - t[: -d - 1], t[d + 1 :] - t[1:-d]
        a = np.where(left > 0, (x - t[: -d - 1]) / np.where(left > 0, left, 1), 0)
        c = np.where(right > 0, (t[d + 1 :] - x) / np.where(right > 0, right, 1), 0)
        b = a * b[:, :-1] + c * b[:, 1:]
    return b


def bspline_derivative(x: np.ndarray, knots: np.ndarray, degree: int, order: int = 1) -> np.ndarray:
    if order == 0:
        return bsplines(x, knots, degree)
    if order > degree:
        return np.zeros((len(x), len(knots) - degree - 1))
    low = bspline_derivative(x, knots, degree - 1, order - 1)
    width = knots[degree:] - knots[:-degree]
    scaled = low * np.where(width[: low.shape[1]] > 0, degree / np.where(width[: low.shape[1]] > 0, width[: low.shape[1]], 1), 0)
    return scaled[:, :-1] - scaled[:, 1:]


def uniform_knots(lo: float, hi: float, k: int, degree: int) -> np.ndarray:
    inner = max(2, k - degree + 1)
    h = (hi - lo) / (inner - 1) or 1.0
    return lo + h * np.arange(-degree, inner + degree)


class Basis:
    """width raw columns, penalties, null_dim; constrain: columns must sum to zero over the data; positive:
    coefficients that enter through exp; inequality (A, b) and equality (A, b) on the raw coefficients."""

    constrain = True
    discrete = False
    positive: np.ndarray | None = None
    inequality: tuple[np.ndarray, np.ndarray] | None = None
    equality: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, spec: SmoothSpec):
        self.spec, self.vars = spec, spec.vars
        self.penalties: list[np.ndarray] = []
        self.null_dim = 0

    @property
    def width(self) -> int:
        return self.penalties[0].shape[0]

    def raw(self, cols) -> np.ndarray:
        raise NotImplementedError

    def x(self, cols, i: int = 0) -> np.ndarray:
        return np.asarray(cols[self.vars[i]], float)


class Cubic(Basis):
    """cr, cs, cc: a cubic spline by its values at quantile knots."""

    def __init__(self, spec, rows, k, knots=None, cyclic=False, shrink=False):
        super().__init__(spec)
        v = self.vars[0]
        self.cyclic = cyclic
        if knots is None:
            few = rows.distinct_count(v)
            knots = rows.distinct(v) if few <= k else rows.quantiles(v, np.linspace(0, 1, k))
        self.knots = np.unique(np.asarray(knots, float))
        if len(self.knots) < 3:
            raise ValueError(f"{spec.label}: at least three distinct values are needed")
        h = np.diff(self.knots)
        n = len(self.knots)
        if cyclic:
            n -= 1
            d, b = np.zeros((n, n)), np.zeros((n, n))
            for i in range(n):
                p, hp, hn = (i - 1) % n, h[(i - 1) % n], h[i]
                nx = (i + 1) % n
                d[i, p] += 1 / hp
                d[i, i] -= 1 / hp + 1 / hn
                d[i, nx] += 1 / hn
                b[i, p] += hp / 6
                b[i, i] += (hp + hn) / 3
                b[i, nx] += hn / 6
            self.curve = np.linalg.solve(b, d)
            self.penalties, self.null_dim = [d.T @ self.curve], 1
        else:
            q = np.zeros((n - 2, n))
            b = np.zeros((n - 2, n - 2))
            for i in range(n - 2):
                q[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
                b[i, i] = (h[i] + h[i + 1]) / 3
                if i:
                    b[i, i - 1] = b[i - 1, i] = h[i] / 6
            inner = np.linalg.solve(b, q)
            self.curve = np.vstack([np.zeros(n), inner, np.zeros(n)])
            self.penalties, self.null_dim = [q.T @ inner], 2
            if shrink:
                s = self.penalties[0]
                self.penalties.append(np.eye(n) * 0.01 * np.trace(s) / n)
                self.null_dim = 0

    def raw(self, cols):
        x, t, n = self.x(cols), self.knots, len(self.knots)
        x = t[0] + np.mod(x - t[0], t[-1] - t[0]) if self.cyclic else np.clip(x, t[0], t[-1])
        j = np.clip(np.searchsorted(t, x, "right") - 1, 0, n - 2)
        h = np.diff(t)[j]
        u = (x - t[j]) / h
        m = n - 1 if self.cyclic else n
        out = np.zeros((len(x), m))
        r = np.arange(len(x))
        nx = (j + 1) % m if self.cyclic else j + 1
        out[r, j] += 1 - u
        out[r, nx] += u
        a, c = ((1 - u) ** 3 - (1 - u)) * h * h / 6, (u**3 - u) * h * h / 6
        return out + a[:, None] * self.curve[j] + c[:, None] * self.curve[nx]


class BSpline(Basis):
    """ps (difference penalty), bs (derivative penalty), cps (cyclic), ad (several local penalties); linear
    beyond the range of the data."""

    def __init__(self, spec, rows, k, kind="ps"):
        super().__init__(spec)
        m = spec.m if isinstance(spec.m, int) else 2
        self.order, self.degree, self.kind = m, m + 1, kind
        lo, hi = rows.range([self.vars[0]])[self.vars[0]]
        self.lo, self.hi = lo, hi if hi > lo else lo + 1.0
        self.cyclic = kind == "cps"
        if self.cyclic:
            h = (self.hi - self.lo) / k
            self.knots = self.lo + h * np.arange(-self.degree, k + self.degree + 1)
            d = np.eye(k)
            for _ in range(m):
                d = np.roll(d, -1, axis=0) - d
            self.penalties, self.null_dim = [d.T @ d], 1
            return
        self.knots = uniform_knots(self.lo, self.hi, k, self.degree)
        k = len(self.knots) - self.degree - 1
        d = difference(k, m)
        if kind == "bs":
            g, w = np.polynomial.legendre.leggauss(self.degree + 1)
            edges = self.knots[self.degree : -self.degree]
            mid, half = (edges[1:] + edges[:-1]) / 2, np.diff(edges) / 2
            at = (mid[:, None] + half[:, None] * g).ravel()
            b = bspline_derivative(np.minimum(at, self.hi - 1e-12 * (self.hi - self.lo)), self.knots, self.degree, m)
            self.penalties = [b.T @ (b * (half[:, None] * w).ravel()[:, None])]
        elif kind == "ad":
            n = int(spec.xt.get("n_penalties", 5))
            at = np.arange(1, len(d) + 1)
            centre, width = np.linspace(0.5, len(d) + 0.5, n), 0.75 * len(d) / max(n - 1, 1)
            w = np.exp(-0.5 * ((at[:, None] - centre) / width) ** 2)
            w /= w.sum(axis=1, keepdims=True)
            self.penalties = [d.T @ (d * w[:, [i]]) for i in range(n)]
        else:
            self.penalties = [d.T @ d]
        self.null_dim = m

    def raw(self, cols):
        x = self.x(cols)
        if self.cyclic:
            x = self.lo + np.mod(x - self.lo, self.hi - self.lo)
            b = bsplines(x, self.knots, self.degree)
            k = self.width
            out = b[:, :k].copy()
            out[:, : b.shape[1] - k] += b[:, k:]
            return out
        inside = np.clip(x, self.lo, self.hi)
        b = bsplines(inside, self.knots, self.degree)
        far = np.flatnonzero(x != inside)
        if len(far):
            b[far] += (x - inside)[far, None] * bspline_derivative(inside[far], self.knots, self.degree)
        return b


def tps_eta(r: np.ndarray, m: int, d: int) -> np.ndarray:
    """The thin-plate kernel of penalty order m in d dimensions."""
    if d % 2 == 0:
        c = (-1) ** (m + 1 + d // 2) / (2 ** (2 * m - 1) * math.pi ** (d / 2) * math.factorial(m - 1) * math.factorial(m - d // 2))
        safe = np.where(r > 0, r, 1.0)
        return c * r ** (2 * m - d) * np.log(safe)
    c = math.gamma(d / 2 - m) / (2 ** (2 * m) * math.pi ** (d / 2) * math.factorial(m - 1))
    return c * r ** (2 * m - d)


def monomials(d: int, below: int) -> list[tuple[int, ...]]:
    """Exponents of the polynomials of total degree under ``below``, by degree."""
    out: list[tuple[int, ...]] = []

    def fill(prefix, left, i):
        if i == d - 1:
            out.append((*prefix, left))
        else:
            for p in range(left, -1, -1):
                fill((*prefix, p), left - p, i + 1)

    for degree in range(below):
        fill((), degree, 0)
    return out


class ThinPlate(Basis):
    """tp, ts, ds: the eigen-truncated thin-plate kernel on at most MOST_KNOTS points, with its polynomials."""

    def __init__(self, spec, rows, k, shrink=False):
        super().__init__(spec)
        d = len(self.vars)
        m = spec.m if isinstance(spec.m, int) else next(i for i in range(1, 20) if 2 * i > d + 1)
        self.m, self.powers = m, monomials(d, m)
        if d == 1:
            v = self.vars[0]
            few = rows.distinct_count(v)
            points = rows.distinct(v)[:, None] if few <= max(3 * k, 200) else rows.quantiles(v, np.linspace(0, 1, max(3 * k, 200)))[:, None]
        else:
            points = rows.points(list(self.vars), min(MOST_KNOTS, max(500, 4 * k)))
        points = np.unique(points, axis=0)
        big = len(self.powers)
        k = max(big + 1, min(k, len(points)))
        self.shift = points.mean(axis=0)
        self.points = points - self.shift
        e = self._kernel(self.points)
        value, vector = np.linalg.eigh(e)
        top = np.argsort(-np.abs(value), kind="stable")[:k]
        value, vector = value[top], vector[:, top]
        t = self._poly(self.points)
        z = null_basis(t.T @ vector)
        self.map = vector @ z
        x = np.hstack([vector * value @ z, t])
        self.scale = np.sqrt((x**2).mean(axis=0))
        self.scale[self.scale == 0] = 1.0
        s = np.zeros((k, k))
        s[: k - big, : k - big] = z.T @ (value[:, None] * z)
        s /= np.outer(self.scale, self.scale)
        self.penalties, self.null_dim = [(s + s.T) / 2], big
        if shrink:
            own = np.zeros((k, k))
            own[k - big :, k - big :] = np.eye(big)
            own[k - big, k - big] = 0.0  # the constant is absorbed
            self.penalties.append(own)
            self.null_dim = 1

    def _kernel(self, x):
        d2 = (x**2).sum(1)[:, None] + (self.points**2).sum(1) - 2 * x @ self.points.T
        return tps_eta(np.sqrt(np.maximum(d2, 0)), self.m, x.shape[1])

    def _poly(self, x):
        return np.column_stack([np.prod(x ** np.array(p), axis=1) for p in self.powers])

    def raw(self, cols):
        x = np.column_stack([self.x(cols, i) for i in range(len(self.vars))]) - self.shift
        return np.hstack([self._kernel(x) @ self.map, self._poly(x)]) / self.scale


class Sphere(Basis):
    """sos: splines on the sphere; latitude and longitude in radians."""

    def __init__(self, spec, rows, k):
        super().__init__(spec)
        self.m = spec.m if isinstance(spec.m, int) else 2
        self.points = np.unique(rows.points(list(self.vars), min(MOST_KNOTS, max(500, 4 * k))), axis=0)
        k = min(k, len(self.points))
        value, vector = np.linalg.eigh(self._kernel(self.points))
        top = np.argsort(-np.abs(value), kind="stable")[: k - 1]
        self.map = vector[:, top] / value[top]
        s = np.zeros((k, k))
        s[: k - 1, : k - 1] = np.diag(1 / np.abs(value[top]))
        self.penalties, self.null_dim = [s], 1

    def _kernel(self, p):
        lat, lon = p[:, 0][:, None], p[:, 1][:, None]
        c = np.sin(lat) * np.sin(self.points[:, 0]) + np.cos(lat) * np.cos(self.points[:, 0]) * np.cos(lon - self.points[:, 1])
        a = np.arccos(np.clip(c, -1, 1))
        return a ** (2 * self.m - 2) * np.log(np.where(a > 0, a, 1.0))

    def raw(self, cols):
        p = np.column_stack([self.x(cols, 0), self.x(cols, 1)])
        return np.hstack([self._kernel(p) @ self.map, np.ones((len(p), 1))])


class OneHot(Basis):
    """re (identity penalty) and mrf (graph Laplacian): a column per level; unseen levels are zero rows."""

    discrete = True

    def __init__(self, spec, rows, kind="re"):
        super().__init__(spec)
        levels = rows.levels(self.vars[0])
        if kind == "mrf":
            nb = spec.xt.get("nb")
            if nb is None:
                raise ValueError(f"{spec.label}: mrf needs xt={{'nb': adjacency}}")
            if isinstance(nb, dict):
                levels = sorted(set(levels) | set(nb))
                a = np.zeros((len(levels),) * 2)
                at = {v: i for i, v in enumerate(levels)}
                for v, near in nb.items():
                    for w in near:
                        a[at[v], at[w]] = a[at[w], at[v]] = 1.0
            else:
                a = np.asarray(nb, float)
                if len(a) != len(levels):
                    raise ValueError(f"{spec.label}: the adjacency has {len(a)} regions, the table {len(levels)}")
            np.fill_diagonal(a, 0)
            self.penalties, self.null_dim = [np.diag(a.sum(1)) - a], 1
        else:
            self.penalties = [np.eye(len(levels))]
        self.levels = levels
        self.at = {v: i for i, v in enumerate(levels)}

    def codes(self, column) -> np.ndarray:
        return np.fromiter((self.at.get(v, -1) for v in column.tolist()), np.int64, len(column))

    def raw(self, cols):
        c = self.codes(cols[self.vars[0]])
        out = np.zeros((len(c), len(self.levels)))
        seen = np.flatnonzero(c >= 0)
        out[seen, c[seen]] = 1.0
        return out


class GaussianProcess(Basis):
    """gp: a stationary correlation to quantile knots. xt: kernel (matern32, matern52, exponential, spherical,
    gaussian) and range."""

    def __init__(self, spec, rows, k):
        super().__init__(spec)
        v = self.vars[0]
        few = rows.distinct_count(v)
        self.knots = rows.distinct(v) if few <= k else rows.quantiles(v, (np.arange(k) + 0.5) / k)
        lo, hi = rows.range([v])[v]
        self.kernel = spec.xt.get("kernel", "matern32")
        self.scale = float(spec.xt.get("range", 0) or (hi - lo) / max(len(self.knots) - 1, 1) or 1.0)
        r = self._rho(np.abs(self.knots[:, None] - self.knots)) + 1e-8 * np.eye(len(self.knots))
        value, vector = np.linalg.eigh(r)
        value = np.maximum(value, 1e-10)
        self.white = vector / np.sqrt(value) @ vector.T
        self.penalties, self.null_dim = [vector / value @ vector.T], 0

    def _rho(self, d):
        u = d / self.scale
        return {
            "matern32": lambda: (1 + math.sqrt(3) * u) * np.exp(-math.sqrt(3) * u),
            "matern52": lambda: (1 + math.sqrt(5) * u + 5 * u * u / 3) * np.exp(-math.sqrt(5) * u),
            "exponential": lambda: np.exp(-u),
            "gaussian": lambda: np.exp(-0.5 * u * u),
            "spherical": lambda: np.where(u < 1, 1 - 1.5 * u + 0.5 * u**3, 0.0),
        }[self.kernel]()

    def raw(self, cols):
        return self._rho(np.abs(self.x(cols)[:, None] - self.knots)) @ self.white


class Loess(Basis):
    """lo: kernel columns at quantile knots with a ridge; degree 2 adds x times each."""

    def __init__(self, spec, rows, k):
        super().__init__(spec)
        v = self.vars[0]
        few = rows.distinct_count(v)
        self.knots = rows.distinct(v) if few <= k else rows.quantiles(v, (np.arange(k) + 0.5) / k)
        lo, hi = rows.range([v])[v]
        self.centre = (lo + hi) / 2
        self.band = float(spec.xt.get("span", 0.75)) * (hi - lo) / max(len(self.knots) - 1, 1) or 1.0
        self.band = max(self.band, 1.01 * float(np.max(np.diff(self.knots), initial=0)))  # no row may fall between kernels
        self.degree, self.kernel = int(spec.xt.get("degree", 1)), spec.xt.get("kernel", "tricube")
        self.penalties, self.null_dim = [np.eye(len(self.knots) * self.degree)], 0

    def raw(self, cols):
        x = self.x(cols)
        u = np.abs(x[:, None] - self.knots) / self.band
        k = np.exp(-0.5 * u * u) if self.kernel == "gaussian" else np.where(u < 1, (1 - np.minimum(u, 1) ** 3) ** 3, 0.0)
        return k if self.degree == 1 else np.hstack([k, (x - self.centre)[:, None] * k])


FP_POWERS = (-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 3.0)


class FractionalPolynomial(Basis):
    """fp: two powers of x (a repeated power times log x), unpenalised; the powers are those of the smallest
    AIC of the 36 pairs, from one pass, if xt names the response as ``y``, else (1, 2) or xt's ``powers``."""

    def __init__(self, spec, rows, k):
        super().__init__(spec)
        lo, hi = rows.range([self.vars[0]])[self.vars[0]]
        self.shift = 0.0 if lo > 0 else -lo + (hi - lo) * 0.01 + 1e-8
        self.unit = max(hi + self.shift, 1e-300)
        self.powers = tuple(spec.xt.get("powers", (1.0, 2.0)))
        self.penalties, self.null_dim = [np.zeros((2, 2))], 2
        response = spec.xt.get("y")
        if response:
            self.powers = self._choose(rows, response)

    def _u(self, cols):
        return np.maximum((self.x(cols) + self.shift) / self.unit, 1e-12)

    def _columns(self, u, p):
        f = [np.log(u) if q == 0 else u**q for q in p]
        if p[0] == p[1]:
            f[1] = f[0] * np.log(u)
        return np.column_stack(f)

    def _choose(self, rows, response):
        pairs = [(p, q) for i, p in enumerate(FP_POWERS) for q in FP_POWERS[i:]]
        everything = sorted({c for pq in pairs for c in ((pq[0], 0), (pq[1], int(pq[0] == pq[1])))})
        at = {c: i + 1 for i, c in enumerate(everything)}

        def block(cols):
            u, y = self._u(cols), np.asarray(cols[response], float)
            x = np.column_stack([np.ones(len(u))] + [(np.log(u) if p == 0 else u**p) * (np.log(u) if logged else 1) for p, logged in everything])
            return {"g": x.T @ x, "b": x.T @ y, "yy": np.array([y @ y])}

        r = rows.sweep(block)

        def rss(pq):
            i = [0, at[pq[0], 0], at[pq[1], int(pq[0] == pq[1])]]
            beta = np.linalg.lstsq(r["g"][np.ix_(i, i)], r["b"][i], rcond=None)[0]
            return float(r["yy"][0] - r["b"][i] @ beta)

        return min(pairs, key=lambda pq: (rss(pq), pq))

    def raw(self, cols):
        return self._columns(self._u(cols), self.powers)


class FactorSmooth(Basis):
    """fs: a copy of a smooth per level with shared penalties; sz: the same with the levels' smooths summing to
    zero over the levels."""

    def __init__(self, spec, rows, k, sum_to_zero=False):
        super().__init__(spec)
        factor = spec.xt.get("by") or next((v for v in reversed(spec.vars) if self._is_factor(rows, v)), spec.vars[-1])
        self.factor = factor
        inner = SmoothSpec(tuple(v for v in spec.vars if v != factor), spec.xt.get("bs", "tp"), k, m=spec.m)
        self.levels = rows.levels(factor)
        self.inner = make(inner, rows)
        w, n = self.inner.width, len(self.levels)
        self.mix = np.vstack([np.eye(n - 1), -np.ones((1, n - 1))]) if sum_to_zero else np.eye(n)
        each = self.mix.T @ self.mix
        self.penalties = [np.kron(each, s) for s in self.inner.penalties]
        if not sum_to_zero:  # the inner null space is penalised, too, so that every level is shrunk
            s = sum(self.inner.penalties)
            value, vector = np.linalg.eigh(s / max(np.abs(s).max(), 1e-300))
            null = vector[:, value < 1e-8]
            self.penalties.append(np.kron(np.eye(n), null @ null.T))
        self.null_dim = 0 if not sum_to_zero else self.inner.null_dim * (n - 1)
        self.n, self.w = n, w

    @staticmethod
    def _is_factor(rows, v):
        c = getattr(rows, "columns", {}).get(v)
        return (c is not None and c.dtype == object) or (c is None and dict(rows.df.dtypes)[v] == "string")

    def raw(self, cols):
        b = self.inner.raw(cols)
        at = {v: i for i, v in enumerate(self.levels)}
        code = np.fromiter((at.get(v, -1) for v in cols[self.factor].tolist()), np.int64, len(b))
        mix = np.vstack([self.mix, np.zeros((1, self.mix.shape[1]))])[code]
        return (mix[:, :, None] * b[:, None, :]).reshape(len(b), -1)


class Spde(Basis):
    """spde: finite elements; hat functions on a line, or linear triangles on a rectangle grid of the range with
    a margin of a twentieth, penalised by mass, stiffness and their square."""

    def __init__(self, spec, rows, k):
        super().__init__(spec)
        r = rows.range(list(self.vars))
        if len(self.vars) == 1:
            lo, hi = r[self.vars[0]]
            self.grid = [np.linspace(lo, hi if hi > lo else lo + 1, max(5, k))]
            n, h = len(self.grid[0]), self.grid[0][1] - self.grid[0][0]
            c = np.zeros((n, n))
            g = np.zeros((n, n))
            for i in range(n - 1):
                c[i : i + 2, i : i + 2] += h / 6 * np.array([[2, 1], [1, 2]])
                g[i : i + 2, i : i + 2] += np.array([[1, -1], [-1, 1]]) / h
        else:
            side = max(3, int(math.sqrt(k)))
            self.grid = [np.linspace(lo - 0.05 * (hi - lo), hi + 0.05 * (hi - lo), side) for lo, hi in (r[v] for v in self.vars)]
            n = side * side
            c, g = np.zeros((n, n)), np.zeros((n, n))
            px, py = np.meshgrid(*self.grid, indexing="ij")
            p = np.column_stack([px.ravel(), py.ravel()])
            for i in range(side - 1):
                for j in range(side - 1):
                    a = i * side + j
                    for tri in ((a, a + side, a + side + 1), (a, a + side + 1, a + 1)):
                        q = p[list(tri)]
                        m = np.column_stack([np.ones(3), q])
                        area = abs(np.linalg.det(m)) / 2
                        slope = np.linalg.inv(m)[1:]
                        ix = np.ix_(tri, tri)
                        c[ix] += area / 12 * (np.ones((3, 3)) + np.eye(3))
                        g[ix] += area * slope.T @ slope
        g2 = g @ np.linalg.solve(c + 1e-10 * np.eye(n), g)
        self.penalties, self.null_dim = [c, 2 * g, (g2 + g2.T) / 2], 0

    def raw(self, cols):
        u, j = [], []
        for i, g in enumerate(self.grid):
            x = np.clip(self.x(cols, i), g[0], g[-1])
            at = np.clip(np.searchsorted(g, x, "right") - 1, 0, len(g) - 2)
            j.append(at)
            u.append((x - g[at]) / (g[at + 1] - g[at]))
        r = np.arange(len(u[0]))
        out = np.zeros((len(r), self.width))
        if len(self.grid) == 1:
            out[r, j[0]], out[r, j[0] + 1] = 1 - u[0], u[0]
            return out
        side = len(self.grid[1])
        a = j[0] * side + j[1]
        lower = u[0] >= u[1]
        mid = np.where(lower, a + side, a + 1)
        big, small = np.maximum(u[0], u[1]), np.minimum(u[0], u[1])
        out[r, a] += 1 - big
        out[r, mid] += big - small
        out[r, a + side + 1] += small
        return out


def inside_polygon(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    a, b = p, np.roll(p, -1, axis=0)
    inside = np.zeros(len(x), bool)
    for (x0, y0), (x1, y1) in zip(a, b, strict=True):
        if y0 != y1:
            crosses = ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
            inside ^= crosses
    return inside


class SoapFilm(Basis):
    """so: a film over a polygon (xt['bnd'], later polygons are holes): cyclic cubic boundary values extended
    harmonically, and twice-solved Laplace sources inside; bilinear on a grid; rows outside are zero."""

    def __init__(self, spec, rows, k):
        super().__init__(spec)
        if "bnd" not in spec.xt:
            raise ValueError(f"{spec.label}: so needs xt={{'bnd': [polygon]}}")
        self.polygons = [np.asarray(b, float) for b in spec.xt["bnd"]]
        cells = int(spec.xt.get("nmax", 32))
        ends = np.vstack(self.polygons)
        lo, hi = ends.min(0), ends.max(0)
        self.step = (hi - lo).max() / (cells - 1)
        self.origin = lo - self.step
        self.shape = tuple(int(math.ceil((hi[i] - lo[i]) / self.step)) + 3 for i in (0, 1))
        gx, gy = np.meshgrid(*(self.origin[i] + self.step * np.arange(self.shape[i]) for i in (0, 1)), indexing="ij")
        inside = self.within(gx.ravel(), gy.ravel()).reshape(self.shape)
        pad = np.pad(inside, 1)
        full = pad[:-2, 1:-1] & pad[2:, 1:-1] & pad[1:-1, :-2] & pad[1:-1, 2:]
        interior, boundary = inside & full, inside & ~full
        n = int(interior.sum())
        if not n:
            raise ValueError(f"{spec.label}: no grid point lies inside the boundary")
        number = np.full(self.shape, -1)
        number[interior] = np.arange(n)
        laplace = np.zeros((n, n))
        ii, jj = np.nonzero(interior)
        edge_at = np.full(self.shape, -1)
        edge_at[boundary] = np.arange(int(boundary.sum()))
        feed = np.zeros((n, int(boundary.sum())))
        for di, dj in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            ni, nj = ii + di, jj + dj
            inner = number[ni, nj]
            laplace[np.arange(n)[inner >= 0], inner[inner >= 0]] += 1
            e = edge_at[ni, nj]
            feed[np.arange(n)[e >= 0], e[e >= 0]] += 1
        laplace -= 4 * np.eye(n)
        ring = self.polygons[0]
        nxt = np.roll(ring, -1, axis=0)
        seg = np.linalg.norm(nxt - ring, axis=1)
        arc0, total = np.concatenate(([0], np.cumsum(seg)[:-1])), seg.sum()
        bi, bj = np.nonzero(boundary)
        bp = np.column_stack([gx[bi, bj], gy[bi, bj]])
        t = np.clip(((bp[:, None] - ring) * (nxt - ring)).sum(2) / np.maximum(seg**2, 1e-300), 0, 1)
        away = np.linalg.norm(bp[:, None] - ring - t[..., None] * (nxt - ring), axis=2)
        which = away.argmin(1)
        arc = arc0[which] + t[np.arange(len(bp)), which] * seg[which]
        kb = max(k // 3, 6)
        ring_spec = SmoothSpec(("arc",), "cc", kb + 1)
        cyc = Cubic(ring_spec, None, kb + 1, knots=np.linspace(0, total, kb + 1), cyclic=True)
        edge = cyc.raw({"arc": arc})
        film = [np.zeros((*self.shape, edge.shape[1]))]
        film[0][bi, bj] = edge
        film[0][ii, jj] = np.linalg.solve(laplace, -feed @ edge)
        ki = max(k - kb, 3)
        pick = np.unique(np.linspace(0, n - 1, ki).astype(int))
        source = np.zeros((n, len(pick)))
        source[pick, np.arange(len(pick))] = 1.0
        u1 = np.linalg.solve(laplace, source)
        u1 /= np.abs(u1).max(0)
        u2 = np.linalg.solve(laplace, u1)
        top = np.abs(u2).max(0)
        film.append(np.zeros((*self.shape, len(pick))))
        film[1][ii, jj] = u2 / top
        self.film = np.concatenate(film, axis=2)
        g = u1 / top
        p = self.film.shape[2]
        s1, s2 = np.zeros((p, p)), np.zeros((p, p))
        s1[: edge.shape[1], : edge.shape[1]] = cyc.penalties[0]
        s2[edge.shape[1] :, edge.shape[1] :] = g.T @ g * self.step**2
        self.penalties, self.null_dim = [s1, s2], 1

    def within(self, x, y):
        ok = inside_polygon(x, y, self.polygons[0])
        for hole in self.polygons[1:]:
            ok &= ~inside_polygon(x, y, hole)
        return ok

    def raw(self, cols):
        x, y = self.x(cols, 0), self.x(cols, 1)
        fx, fy = (x - self.origin[0]) / self.step, (y - self.origin[1]) / self.step
        i = np.clip(np.floor(fx).astype(int), 0, self.shape[0] - 2)
        j = np.clip(np.floor(fy).astype(int), 0, self.shape[1] - 2)
        u, v = (fx - i)[:, None], (fy - j)[:, None]
        f = self.film
        out = (1 - u) * (1 - v) * f[i, j] + u * (1 - v) * f[i + 1, j] + (1 - u) * v * f[i, j + 1] + u * v * f[i + 1, j + 1]
        out[~self.within(x, y)] = 0.0
        return out


def shape_matrix(kind: str, q: int) -> np.ndarray:
    """Maps increments to B-spline coefficients: sums for monotone shapes, double sums for curved ones. The
    first coefficient (the level) is left out, the constant belongs to the intercept."""
    n = q - 1
    once = np.tril(np.ones((n, n)))
    if kind in ("mpi", "mpd"):
        inner = once if kind == "mpi" else -once
    elif kind in ("cx", "cv"):  # free slope, then curvature of one sign
        inner = np.hstack([np.arange(1, n + 1)[:, None], (once @ once)[:, 1:] * (1 if kind == "cx" else -1)])
        inner[:, 1:] = np.vstack([np.zeros((1, n - 1)), (np.tril(np.ones((n - 1, n - 1))) @ np.tril(np.ones((n - 1, n - 1)))) * (1 if kind == "cx" else -1)])
    elif kind in ("micx", "mdcv"):
        inner = (once @ once) * (1 if kind == "micx" else -1)
    else:  # micv, mdcx: slopes shrink towards zero
        i, j = np.arange(1, n + 1)[:, None], np.arange(1, n + 1)[None]
        inner = np.minimum(i, n - j + 1).astype(float) * (1 if kind == "micv" else -1)
    return np.vstack([np.zeros((1, n)), inner])


class ShapeSpline(BSpline):
    """mpi mpd cx cv micx micv mdcx mdcv: B-splines whose increments enter as exponentials."""

    constrain = False  # columns are centred instead, which keeps the signs

    def __init__(self, spec, rows, k, kind):
        super().__init__(spec, rows, k, "ps")
        self.sigma = shape_matrix(kind, self.width)
        n = self.sigma.shape[1]
        free = kind in ("cx", "cv")
        d = difference(n - free, 1)
        s = np.zeros((n, n))
        s[free:, free:] = d.T @ d
        self.positive = np.ones(n, bool)
        self.positive[0] = not free
        self.penalties, self.null_dim = [s], 1 + free
        self.mean = np.zeros(n)

    def raw(self, cols):
        return super().raw(cols) @ self.sigma


class ConstrainedSpline(BSpline):
    """sc, scad: B-splines under linear inequalities, xt['constraints'] of '+', 'm+', 'm-', 'c+', 'c-'."""

    def __init__(self, spec, rows, k, kind):
        super().__init__(spec, rows, k, "bs" if kind == "sc" else "ad")
        n = self.width
        a = []
        for c in spec.xt.get("constraints", []):
            if c == "+":
                a.append(np.eye(n))
            else:
                d = difference(n, 1 if c[0] == "m" else 2)
                a.append(d if c[1] == "+" else -d)
        if a:
            self.inequality = (np.vstack(a), np.zeros(sum(len(x) for x in a)))
            self.constrain = not any(c == "+" for c in spec.xt["constraints"])


class Tensor(Basis):
    """te, ti, t2: row-wise Kronecker products of marginal bases."""

    def __init__(self, spec, rows):
        super().__init__(spec)
        d = len(spec.vars)
        names = (spec.bs,) * d if isinstance(spec.bs, str) else spec.bs
        ks = spec.k if isinstance(spec.k, tuple) else (spec.k,) * d
        if isinstance(spec.k, int) and spec.k > 0:
            ks = (max(3, round(spec.k ** (1 / d))) if spec.k > 12 and d > 1 and spec.kind == "t2" else spec.k,) * d
        self.margins = [make(SmoothSpec((v,), b, 5 if k == -1 else k, m=spec.m if isinstance(spec.m, int) else None), rows) for v, b, k in zip(spec.vars, names, ks, strict=True)]
        self.turns: list[np.ndarray] = []
        for m in self.margins:
            # columns that sum to zero over the margin's knots drop the main effects of ti
            self.turns.append(np.eye(m.width))
        self.kind = spec.kind
        self._finish()

    def _finish(self):
        w = [t.shape[1] for t in self.turns]
        inner = [[t.T @ s @ t for s in m.penalties[:1]] for m, t in zip(self.margins, self.turns, strict=True)]
        self.penalties = []
        scaled = [p[0] / max(np.linalg.norm(p[0], 2), 1e-300) for p in inner]
        for i, s in enumerate(scaled):
            out = np.eye(1)
            for j, n in enumerate(w):
                out = np.kron(out, s if i == j else np.eye(n))
            self.penalties.append(out)
        if self.kind == "t2":
            both = np.eye(1)
            for s in scaled:
                both = np.kron(both, s)
            self.penalties.append(both)
        self.null_dim = int(np.prod([m.null_dim for m in self.margins]))

    def interact(self, means: list[np.ndarray]) -> None:
        """ti: each margin's columns are made to sum to zero over the data, given their means."""
        self.turns = [null_basis(c) for c in means]
        self.constrain = False
        self._finish()
        self.null_dim = int(np.prod([max(m.null_dim - 1, 0) for m in self.margins]))

    def raw(self, cols):
        out = None
        for m, t in zip(self.margins, self.turns, strict=True):
            b = m.raw(cols) @ t
            out = b if out is None else (out[:, :, None] * b[:, None, :]).reshape(len(b), -1)
        return out


def make(spec: SmoothSpec, rows) -> Basis:
    """The basis of a smooth term, built from a few statistics of the rows."""
    if spec.kind != "s":
        basis = Tensor(spec, rows)
        if spec.kind == "ti":
            margins = basis.margins
            r = rows.sweep(lambda cols: {f"m{i}": m.raw(cols).sum(0) for i, m in enumerate(margins)})
            basis.interact([r[f"m{i}"] for i in range(len(margins))])
        return basis
    bs = spec.bs if isinstance(spec.bs, str) else spec.bs[0]
    d = len(spec.vars) - (bs in ("fs", "sz"))
    k = spec.k if isinstance(spec.k, int) else spec.k[0]
    if k == -1:
        k = 50 if bs == "sos" else 10 if d == 1 else (30 if bs in ("tp", "ts", "fs", "sz") else 25) if d == 2 else 10 * d
    if d > 1 and bs not in ("tp", "ts", "ds", "so", "sos", "spde", "fs", "sz", "re"):
        raise ValueError(f"{spec.label}: {bs} takes one column; use te, ti or t2")
    if bs in ("tp", "ts", "ds"):
        return ThinPlate(spec, rows, k, shrink=bs == "ts")
    if bs in ("cr", "cs", "cc"):
        return Cubic(spec, rows, k, cyclic=bs == "cc", shrink=bs == "cs")
    if bs in ("ps", "bs", "cps", "ad"):
        return BSpline(spec, rows, max(k, 5), bs)
    if bs in ("re", "mrf"):
        return OneHot(spec, rows, bs)
    if bs in SHAPES:
        return ShapeSpline(spec, rows, max(k, 5), bs)
    if bs in ("sc", "scad"):
        return ConstrainedSpline(spec, rows, max(k, 5), bs)
    if bs in ("fs", "sz"):
        return FactorSmooth(spec, rows, k, bs == "sz")
    return {"gp": GaussianProcess, "lo": Loess, "fp": FractionalPolynomial, "so": SoapFilm, "sos": Sphere, "spde": Spde}[bs](spec, rows, k)
