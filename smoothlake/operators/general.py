"""The general optimizer: Newton's method on the penalised likelihood itself, and smoothing parameters by the
Laplace approximation of its marginal likelihood with exact gradients.

A pass at given coefficients adds up the likelihood's gradient and its observed (not expected) information. Once the
coefficients have settled, one more pass gives what the gradient of the criterion needs: by implicit differentiation a
coefficient moves with a log smoothing parameter as ``-A^-1 S_j b``, and the information moves with the coefficients
through each row's third derivative, which enters as ``sum h'_i a_i x_i`` with ``a_i`` the row's leverage. That is p numbers
for all smoothing parameters together. Outer steps are Newton steps whose curvature is that of the working linear model,
corrected by what the gradients say; the coefficients are carried along by their derivatives, so that few inner steps follow.

The criterion, with the dispersion s (one where it is known) and penalty ``S / s``:
``V = ls(s) - (D + b'Sb) / 2s + log|S|+ / 2 - log|H + S| / 2 + M / 2 log(2 pi s)``.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from smoothlake.operators.families import Family
from smoothlake.operators.gam import COUNT, OFFSET, WEIGHT, WITHIN, GamControl, _finish, is_compressed
from smoothlake.operators.model import GamModel
from smoothlake.operators.smoothing import BOUND, Selector, Working, inverse, log_det
from smoothlake.plans.design import Design
from smoothlake.sources.rows import SparkRows

FAMILIES = ("normal", "poisson", "binomial", "gamma", "inverse_gaussian")
STEP = 1e-3  # of the log dispersion, for the saturated likelihood's derivatives


def eta_derivatives(family: Family, y, mu, eta, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First to third derivative in the linear predictor of the log-likelihood with dispersion one."""
    v, v1, v2 = family.variance(mu), family.variance_d(mu), family.variance_d2(mu)
    m1, m2, m3 = family.link.d1(eta), family.link.d2(eta), family.link.d3(eta)
    r = y - mu
    g = w * r / v
    g1 = -w * (1 / v + r * v1 / v**2)
    g2 = w * (2 * v1 / v**2 - r * v2 / v**2 + 2 * r * v1**2 / v**3)
    return g * m1, g1 * m1**2 + g * m2, g2 * m1**3 + 3 * g1 * m1 * m2 + g * m3


def predictor(design: Design, family: Family, cols, beta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Model matrix, linear predictor and mean of a block."""
    x = design.matrix(cols)
    eta = x @ beta + np.asarray(cols[OFFSET], float)
    return x, eta, family.clip(family.link.inv(eta))


class GeneralFit:
    """The state of one fit: coefficients, log smoothing parameters, dispersion, and the sums of the last pass."""

    def __init__(self, design: Design, rows, table, family: Family, control: GamControl, n: int, start=None):
        if family.name not in FAMILIES:
            raise ValueError(f"the general optimizer takes the families {', '.join(FAMILIES)}, not {family.name}")
        self.design, self.rows, self.table, self.family, self.control, self.n = design, rows, table, family, control, n
        self.selector = Selector(design, "REML", control.gamma)
        self.response = design.formula.response
        self.passes = 0
        self.beta = np.zeros(design.p) if start is None else np.asarray(start, float)
        self.scale: float | None = None
        self.sums: dict[str, np.ndarray] = {}

    def sweep(self, beta) -> dict[str, np.ndarray]:
        """Deviance, gradient and observed information at ``beta``, with the sums that a model reports."""
        design, family, response = self.design, self.family, self.response

        def block(cols):
            x, eta, mu = predictor(design, family, cols, beta)
            y, w = np.asarray(cols[response], float), np.asarray(cols[WEIGHT], float)
            l1, l2, _ = eta_derivatives(family, y, mu, eta, w)
            v = np.maximum(family.variance(mu), 1e-300)
            dev, pearson = family.deviance(y, mu, w), w * (y - mu) ** 2 / v
            if WITHIN in cols:
                dev, pearson = dev + cols[WITHIN], pearson + cols["__spread"] / v
            count = (cols[COUNT] if COUNT in cols else w > 0).sum()
            return {"g": x.T @ l1, "h": -(x.T @ (x * l2[:, None])), "s": np.array([dev.sum(), pearson.sum(), w.sum(), (w * y).sum(), count])}

        self.passes += 1
        return self.rows.sweep(block)

    def _third(self, inv) -> np.ndarray:
        """``sum h'_i a_i x_i`` for the information's change with the coefficients."""
        design, family, response, beta = self.design, self.family, self.response, self.beta

        def block(cols):
            x, eta, mu = predictor(design, family, cols, beta)
            l3 = eta_derivatives(family, np.asarray(cols[response], float), mu, eta, np.asarray(cols[WEIGHT], float))[2]
            return {"t": -(x.T @ (l3 * np.einsum("ij,jk,ik->i", x, inv, x)))}

        self.passes += 1
        return self.rows.sweep(block)["t"]

    def _saturated(self, scales: list[float]) -> np.ndarray:
        """The saturated likelihood at some dispersions, of responses and weights alone."""
        family, response = self.family, self.response

        def block(cols):
            y, w = np.asarray(cols[response], float), np.asarray(cols[WEIGHT], float)
            y, w = y[w > 0], w[w > 0]
            return {"l": np.array([family.loglik(y, y, w, s).sum() for s in scales])}

        rows = SparkRows(self.table.select(f"`{response}`", WEIGHT), self.n) if is_compressed(self.rows) else self.rows
        return rows.sweep(block)["l"]

    def begin(self) -> None:
        """Coefficients of the first working model, unless some were given."""
        family, response, design = self.family, self.response, self.design

        def block(cols):
            x = design.matrix(cols)
            y, w = np.asarray(cols[response], float), np.asarray(cols[WEIGHT], float)
            mu = family.clip(family.start(y, w))
            eta = family.link.g(mu)
            ww = w * family.link.d1(eta) ** 2 / family.variance(mu)
            xw = x * ww[:, None]
            return {"g": x.T @ xw, "b": xw.T @ (eta - cols[OFFSET])}

        self.passes += 1
        r = self.rows.sweep(block)
        self.rho = self.selector.start(r["g"])
        if not np.any(self.beta):
            self.beta = inverse(r["g"] + self.selector.penalty(self.rho)) @ r["b"]

    def settle(self, rho, beta) -> tuple[np.ndarray, dict]:
        """Newton's method for the coefficients at given smoothing: (coefficients, sums there)."""
        s = self.selector.penalty(rho)
        now = self.sweep(beta)
        value = now["s"][0] / 2 + beta @ s @ beta / 2
        for _ in range(self.control.max_iterations):
            grad = now["g"] - s @ beta
            step = descent(now["h"] + s, grad)
            gain = step @ grad
            if gain < self.control.epsilon**1.5 * (abs(value) + 0.1):
                return beta, now
            size = min(1.0, 10 * max(np.linalg.norm(beta), 1.0) / max(np.linalg.norm(step), 1e-300))
            for _ in range(25):
                then = self.sweep(beta + size * step)
                better = then["s"][0] / 2 + (beta + size * step) @ s @ (beta + size * step) / 2
                if np.isfinite(better) and better <= value + 1e-12 * abs(value):
                    break
                size /= 2
            else:
                return beta, now
            beta, now, value = beta + size * step, then, better
        return beta, now

    def _dispersion(self, penalised: float, null: int, count: float) -> tuple[float, float]:
        """The dispersion at which the criterion is largest, and the saturated likelihood there."""
        if not hasattr(self, "_unit"):
            self._unit = float(self._saturated([1.0])[0])  # at dispersion one
        if self.family.known_scale:
            return 1.0, self._unit
        first = max(penalised / max(count - null, 1), 1e-300)
        if self.family.name in ("normal", "inverse_gaussian"):
            return first, self._unit - count / 2 * np.log(first)
        log_s = np.log(first if self.scale is None else self.scale)
        for _ in range(30):
            # in log s, the criterion is ls(s) - penalised / 2s + null / 2 log s and a constant
            low, mid, high = self._saturated([float(np.exp(log_s + d)) for d in (-STEP, 0, STEP)])
            half = penalised / (2 * np.exp(log_s))
            d1, d2 = (high - low) / (2 * STEP) + half + null / 2, (high + low - 2 * mid) / STEP**2 - half
            move = float(np.clip(-d1 / d2 if d2 < 0 else np.sign(d1), -1, 1))
            log_s += move
            if abs(move) < 1e-6:  # the likelihood moves by the square of that
                return float(np.exp(log_s)), float(mid + d1 * move)
        return float(np.exp(log_s)), float(mid)

    def criterion(self, rho, beta, sums) -> tuple[float, float]:
        """(V, dispersion) at settled coefficients."""
        s = self.selector.penalty(rho)
        penalised, null = float(sums["s"][0] + beta @ s @ beta), self.design.p - self.selector.rank
        scale, ls = self._dispersion(penalised, null, float(sums["s"][4]))
        det = log_det(positive(sums["h"] + s))
        return ls - penalised / (2 * scale) + self.selector.log_det_penalty(rho) / 2 - det / 2 + null / 2 * np.log(2 * np.pi * scale), scale

    def gradient(self, rho, beta, sums, scale) -> tuple[np.ndarray, np.ndarray]:
        """(dV / d rho over free parameters, d beta / d rho as columns)."""
        s = self.selector.penalty(rho)
        inv = inverse(positive(sums["h"] + s))
        third = self._third(inv)
        plus = self.selector.penalty_traces(rho)
        grad, moves = [], []
        for j in self.selector.free:
            u = np.exp(rho[j]) * self.selector.units[j]
            move = -inv @ (u @ beta)
            trace = float((inv * u).sum()) + float(third @ move)
            grad.append(-float(beta @ u @ beta) / (2 * scale) + plus[j] / 2 - trace / 2)
            moves.append(move)
        return np.array(grad), np.array(moves).T.reshape(self.design.p, len(moves))

    def _curvature(self, rho, beta, sums, scale) -> np.ndarray:
        """Second derivatives of the working linear model's criterion, on the driver: the outer steps' first metric."""
        h, free, step = positive(sums["h"]), self.selector.free, 1e-2
        b = h @ beta + sums["g"]
        w = Working(h, b, float(sums["s"][1] + beta @ h @ beta), float(self.n), scale)

        def slope(r):
            s = self.selector.penalty(r)
            inv = inverse(w.g + s)
            at = inv @ w.b
            plus = self.selector.penalty_traces(r)
            return np.array([np.exp(r[j]) * (at @ self.selector.units[j] @ at / scale + (inv * self.selector.units[j]).sum()) / 2 - plus[j] / 2 for j in free])

        out = np.zeros((len(free), len(free)))
        for i, j in enumerate(free):
            e = np.zeros(len(rho))
            e[j] = step
            out[i] = (slope(rho + e) - slope(rho - e)) / (2 * step)
        value, vector = np.linalg.eigh((out + out.T) / 2)
        return (vector * np.maximum(np.abs(value), 1e-2)) @ vector.T

    def run(self) -> GamModel:
        self.begin()
        rho, free = self.rho, self.selector.free
        beta, sums = self.settle(rho, self.beta)
        self.beta = beta
        value, self.scale = self.criterion(rho, beta, sums)
        converged = not free
        if free:
            grad, moves = self.gradient(rho, beta, sums, self.scale)
            metric = self._curvature(rho, beta, sums, self.scale)
            for _ in range(self.control.max_iterations):
                at_bound = ((rho[free] <= -BOUND) & (grad < 0)) | ((rho[free] >= BOUND) & (grad > 0))
                if np.abs(np.where(at_bound, 0.0, grad)).max() < 1e-5 * (1 + abs(value) * 1e-3):
                    converged = True
                    break
                step = np.where(at_bound, 0.0, np.linalg.solve(metric, grad))
                step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
                size = 1.0
                for _ in range(15):
                    new = rho.copy()
                    new[free] = np.clip(rho[free] + size * step, -BOUND, BOUND)
                    self.beta, then = self.settle(new, beta + moves @ (new[free] - rho[free]))
                    better, scale = self.criterion(new, self.beta, then)
                    if better > value - 1e-10 * (1 + abs(value)):
                        break
                    size /= 3
                else:  # no step raises the criterion
                    self.beta = beta
                    converged = bool(np.abs(grad).max() < 1e-2)
                    break
                moved = new[free] - rho[free]
                done = abs(better - value) < self.control.epsilon * (1 + abs(value)) and np.abs(moved).max() < 1e-4
                rho, beta, sums, value, self.scale = new, self.beta, then, better, scale
                last = grad
                grad, moves = self.gradient(rho, beta, sums, self.scale)
                turn = last - grad  # of the slope of -V
                if turn @ moved > 1e-10:  # the metric is brought to agree with what the slopes did
                    ms = metric @ moved
                    metric = metric - np.outer(ms, ms) / (moved @ ms) + np.outer(turn, turn) / (turn @ moved)
                if done:
                    converged = True
                    break
        return self._model(rho, beta, sums, value, converged)

    def _model(self, rho, beta, sums, value, converged) -> GamModel:
        dev, pearson, weight, wy, count = sums["s"]
        h = positive(sums["h"])
        w = Working(h, h @ beta, float(beta @ h @ beta), float(count), 1.0 if self.family.known_scale else None)
        stats = {"s": np.array([w.zz, dev, pearson, weight, wy, count, 0.0])}
        m = _finish(self.design, self.rows, self.table, replace(self.family), self.selector, rho, beta, stats, w, self.n, self.passes, converged, False)
        m.criterion, m.rhs = -float(value), h @ beta
        return m


def descent(a: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """A direction in which the penalised likelihood rises: Newton's, after negative curvature is turned about."""
    return inverse(positive(a)) @ grad


def positive(a: np.ndarray) -> np.ndarray:
    """The matrix itself if it is positive definite; else with eigenvalues made positive."""
    d = np.sqrt(np.maximum(np.abs(np.diag(a)), 1e-300))
    scaled = (a + a.T) / 2 / d[:, None] / d
    try:
        np.linalg.cholesky(scaled + 1e-13 * np.eye(len(a)))
        return (a + a.T) / 2
    except np.linalg.LinAlgError:
        value, vector = np.linalg.eigh(scaled)
        value = np.maximum(np.abs(value), 1e-10 * max(np.abs(value).max(), 1e-300))
        return (vector * value) @ vector.T * d[:, None] * d


def fit_general(design: Design, rows, table, family: Family, control: GamControl, n: int, start=None) -> GamModel:
    return GeneralFit(design, rows, table, family, control, n, start).run()
