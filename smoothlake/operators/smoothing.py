"""Smoothness selection on the driver, from a Gram matrix: no pass over the rows is needed here.

Criteria: REML, ML (with the scale profiled or known), GCV, UBRE. REML starts with Fellner-Schall steps and is
polished by Newton steps on the log smoothing parameters, as are the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BOUND = 15.0


def solve_spd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return inverse(a) @ b


def factor(a: np.ndarray) -> np.ndarray:
    """Cholesky factor of a scaled matrix, with as little ridge as it takes."""
    ridge = 0.0
    scale = np.trace(a) / len(a) or 1.0
    for _ in range(14):
        try:
            return np.linalg.cholesky(a + ridge * scale * np.eye(len(a)))
        except np.linalg.LinAlgError:
            ridge = max(1e-14, ridge * 10)
    raise np.linalg.LinAlgError("the penalised Gram matrix is not positive definite")


def inverse(a: np.ndarray) -> np.ndarray:
    d = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    c = factor(a * d[:, None] * d)
    i = np.linalg.solve(c, np.eye(len(a)))
    return (i.T @ i) * d[:, None] * d


def log_det(a: np.ndarray) -> float:
    d = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return float(2 * np.log(np.diag(factor(a / d[:, None] / d))).sum() + 2 * np.log(d).sum())


@dataclass
class Working:
    """Sufficient statistics of the (working) linear model; zz includes the part no coefficient touches."""

    g: np.ndarray
    b: np.ndarray
    zz: float
    n: float
    scale: float | None = None  # known dispersion
    ls: float = 0.0


class Selector:
    """Chooses log smoothing parameters for one design."""

    def __init__(self, design, method: str = "REML", gamma: float = 1.0):
        self.design, self.method, self.gamma = design, method.upper(), gamma
        if self.method not in ("REML", "ML", "GCV", "UBRE"):
            raise ValueError(f"unknown method {method!r}; REML, ML, GCV or UBRE")
        self.units = [design.unit(j) for j in range(len(design.penalties))]
        self.free = [j for j, p in enumerate(design.penalties) if p.fixed is None]
        self.rank = self._rank()

    def _rank(self) -> int:
        if not self.units:
            return 0
        s = sum(u / max(np.abs(u).max(), 1e-300) for u in self.units)
        return int(np.linalg.matrix_rank(s, tol=1e-9, hermitian=True))

    def start(self, g: np.ndarray) -> np.ndarray:
        """Log smoothing parameters that leave each term about four tenths of its freedom."""
        rho = np.zeros(len(self.units))
        for j, (u, p) in enumerate(zip(self.units, self.design.penalties, strict=True)):
            if p.fixed is not None:
                rho[j] = np.log(max(p.fixed, 1e-300)) if p.fixed > 0 else -60.0
                continue
            on = np.flatnonzero(np.diag(u) > 1e-9 * np.diag(u).max(initial=0))
            if len(on):
                rho[j] = np.clip(np.log(max(np.median(np.diag(g)[on] / np.diag(u)[on]), 1e-10)), -10, 12)
        return rho

    def penalty(self, rho):
        s = np.zeros((self.design.p, self.design.p))
        for r, u in zip(rho, self.units, strict=True):
            s += np.exp(r) * u
        return s

    def log_det_penalty(self, rho) -> float:
        """Log of the product of the nonzero eigenvalues, block by block on the columns that a group of
        overlapping penalties touches."""
        total = 0.0
        for group, at, base in self._groups():
            s = sum(np.exp(rho[j]) * self.units[j][np.ix_(at, at)] for j in group)
            s = base.T @ s @ base
            if s.size:
                total += log_det(s)
        return total

    def penalty_traces(self, rho) -> dict[int, float]:
        """Of each penalty, the derivative of the log determinant in its log smoothing parameter."""
        out = {}
        for group, at, base in self._groups():
            m = sum(np.exp(rho[j]) * self.units[j][np.ix_(at, at)] for j in group)
            back = base @ inverse(base.T @ m @ base) @ base.T if base.size else np.zeros((len(at), len(at)))
            for j in group:
                out[j] = float(np.exp(rho[j]) * (back * self.units[j][np.ix_(at, at)]).sum())
        return out

    def _groups(self):
        if not hasattr(self, "_grouped"):
            sets = [set(np.flatnonzero(np.abs(u).sum(0) > 0).tolist()) for u in self.units]
            groups: list[tuple[list[int], set]] = []
            for j, mine in enumerate(sets):
                hit = [g for g in groups if g[1] & mine]
                merged = ([*(i for g in hit for i in g[0]), j], set(mine).union(*(g[1] for g in hit)))
                groups = [g for g in groups if g not in hit] + [merged]
            self._grouped = []
            for js, cols in groups:
                at = np.array(sorted(cols))
                s = sum(self.units[j][np.ix_(at, at)] / max(np.abs(self.units[j]).max(), 1e-300) for j in js) if len(at) else np.zeros((0, 0))
                value, vector = np.linalg.eigh(s) if len(at) else (np.zeros(0), np.zeros((0, 0)))
                self._grouped.append((js, at, vector[:, value > 1e-9 * max(value.max(initial=0), 1e-300)]))
        return self._grouped

    def score(self, rho, w: Working, method: str | None = None) -> float:
        method = method or self.method
        s = self.penalty(rho)
        a = w.g + s
        inv = inverse(a)
        beta = inv @ w.b
        edf = float((inv * w.g).sum())
        rss = max(w.zz - 2 * beta @ w.b + beta @ w.g @ beta, 1e-12 * abs(w.zz))
        if method == "GCV":
            return w.n * rss / max(w.n - self.gamma * edf, 1e-6) ** 2
        if method == "UBRE":
            scale = w.scale or 1.0
            return rss / w.n + 2 * self.gamma * scale * edf / w.n - scale
        dp = max(w.zz - beta @ w.b, 1e-12 * abs(w.zz) + 1e-300)
        null = self.design.p - self.rank
        if method == "ML":
            # integrate over the penalised space only
            z = self._range()
            det = log_det(z.T @ a @ z) if z.size else 0.0
            lost = 0
        else:
            det, lost = log_det(a), null
        det -= self.log_det_penalty(rho)
        if w.scale:
            return dp / (2 * w.scale * self.gamma) + det / 2 - lost / 2 * np.log(2 * np.pi * w.scale)
        m = w.n / self.gamma - lost
        scale = dp / self.gamma / m
        return m / 2 * (1 + np.log(2 * np.pi * scale)) + det / 2

    def _range(self):
        if not hasattr(self, "_range_basis"):
            s = sum((u / max(np.abs(u).max(), 1e-300) for u in self.units), np.zeros((self.design.p,) * 2))
            value, vector = np.linalg.eigh(s)
            self._range_basis = vector[:, value > 1e-9 * max(value.max(initial=0), 1e-300)]
        return self._range_basis

    def fellner_schall(self, rho, w: Working, steps: int = 30) -> np.ndarray:
        rho = rho.copy()
        for _ in range(steps):
            s = self.penalty(rho)
            inv = inverse(w.g + s)
            beta = inv @ w.b
            edf = float((inv * w.g).sum())
            scale = w.scale or max(w.zz - 2 * beta @ w.b + beta @ w.g @ beta, 1e-12 * abs(w.zz)) / max(w.n - edf, 1.0)
            plus = {j: v / np.exp(rho[j]) for j, v in self.penalty_traces(rho).items()}
            moved = 0.0
            for j in self.free:
                u = self.units[j]
                up = max(plus[j] - float((inv * u).sum()), 1e-12)
                down = max(beta @ u @ beta / scale, 1e-12)
                new = np.clip(rho[j] + np.clip(np.log(up / down), -3, 3), -BOUND, BOUND)
                moved = max(moved, abs(new - rho[j]))
                rho[j] = new
            if moved < 1e-4:
                break
        return rho

    def select(self, w: Working, rho: np.ndarray | None = None, newton: int = 25) -> np.ndarray:
        """The minimiser of the criterion from ``rho`` (or a start of its own)."""
        rho = self.start(w.g) if rho is None else rho.copy()
        if not self.free:
            return rho
        if self.method in ("REML", "ML"):
            rho = self.fellner_schall(rho, w)
        f = lambda r: self.score(r, w)
        now, h = f(rho), 1e-3
        k = len(self.free)
        for _ in range(newton):
            grad, hess = np.zeros(k), np.zeros((k, k))
            steps = [np.eye(len(rho))[j] * h for j in self.free]
            ups, downs = [f(rho + e) for e in steps], [f(rho - e) for e in steps]
            for i in range(k):
                grad[i] = (ups[i] - downs[i]) / (2 * h)
                hess[i, i] = (ups[i] + downs[i] - 2 * now) / h**2
            if k <= 6:
                for i in range(k):
                    for j in range(i):
                        both = f(rho + steps[i] + steps[j])
                        hess[i, j] = hess[j, i] = (both - ups[i] - ups[j] + now) / h**2
            if np.abs(grad).max() < 1e-6 * (1 + abs(now)):
                break
            value, vector = np.linalg.eigh(hess)
            value = np.maximum(np.abs(value), 1e-6 * max(np.abs(value).max(), 1e-12))
            step = -vector @ ((vector.T @ grad) / value)
            step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
            size = 1.0
            for _ in range(12):
                new = rho.copy()
                new[self.free] = np.clip(new[self.free] + size * step, -BOUND, BOUND)
                then = f(new)
                if then < now:
                    break
                size /= 2
            else:
                break
            done = now - then < 1e-9 * (1 + abs(now))
            rho, now = new, then
            if done:
                break
        return rho
