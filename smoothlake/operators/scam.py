"""Shape-constrained fits: increments that enter as exponentials (``scam``), and linear inequality and equality
constraints by quadratic programming (``scasm``). Both work on the Gram matrix of the working model, so a
Gaussian fit takes one pass over the rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from smoothlake.functions.special import expit, log1pexp
from smoothlake.operators.gam import GamControl, _finish, gam, working_pass
from smoothlake.operators.smoothing import Selector, Working, inverse


@dataclass(frozen=True)
class ScamControl(GamControl):
    """max_iterations: passes. outer, inner: rounds of smoothing selection after a pass, and Newton steps in each.
    not_exp: increments are log(1 + exp(raw)) instead of exponentials, which keeps steps small where they are large."""

    max_iterations: int = 200
    outer: int = 25
    inner: int = 60
    not_exp: bool = False


def scam_control(**options) -> ScamControl:
    return ScamControl(**options)


def has_shape_constraints(design) -> bool:
    return bool(design.positive().any())


class _Seen:
    """A design as the selector sees it, after its columns were mapped to fewer ones."""

    def __init__(self, design, turn: np.ndarray):
        self.p, self.penalties, self.base, self.turn = turn.shape[1], design.penalties, design, turn

    def unit(self, j):
        return self.turn.T @ self.base.unit(j) @ self.turn


def solve_qp(g: np.ndarray, b: np.ndarray, a: np.ndarray | None, lo: np.ndarray | None, e: np.ndarray | None = None, d: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """min x'gx/2 - b'x with a x >= lo and e x = d: (x, active rows of a). Dual steps: nonnegative multipliers
    of the inequalities by projected coordinate descent with an exact finish on the active set."""
    if e is not None and len(e):
        x0 = np.linalg.lstsq(e, d, rcond=None)[0]
        _, s, vt = np.linalg.svd(e)
        z = vt[int((s > 1e-10 * s[0]).sum()) :].T
        y, active = solve_qp(z.T @ g @ z, z.T @ (b - g @ x0), None if a is None else a @ z, None if a is None else lo - a @ x0)
        return x0 + z @ y, active
    inv = inverse(g)
    x = inv @ b
    if a is None or not len(a) or (a @ x >= lo - 1e-10).all():
        return x, np.zeros(0, int)
    q = a @ inv @ a.T
    c = lo - a @ x
    lam = np.zeros(len(a))
    diag = np.maximum(np.diag(q), 1e-14)
    r = c - q @ lam
    for _ in range(4000):
        moved = 0.0
        for i in range(len(lam)):
            new = max(0.0, lam[i] + r[i] / diag[i])
            if new != lam[i]:
                r -= q[:, i] * (new - lam[i])
                moved = max(moved, abs(new - lam[i]) * diag[i])
                lam[i] = new
        if moved < 1e-11 * (1 + np.abs(c).max()):
            break
    active = np.flatnonzero(lam > 0)
    if len(active):
        u = np.linalg.lstsq(q[np.ix_(active, active)], c[active], rcond=1e-12)[0]
        if (u >= -1e-9).all():
            lam = np.zeros(len(a))
            lam[active] = np.maximum(u, 0)
    return x + inv @ a.T @ lam, active


def _exponential(design, w: Working, method: str, control: ScamControl, raw: np.ndarray | None, rho):
    """Positive coefficients as exponentials: linearised around the raw coefficients until they settle. The
    smoothing parameters are chosen on the linearised model and held while the coefficients converge."""
    pos = design.positive()
    selector = Selector(design, method, control.gamma)
    soft = control.not_exp
    if raw is None:
        start = inverse(w.g + selector.penalty(selector.start(w.g))) @ w.b
        least = np.clip(start, 0.05 * np.abs(start[pos]).mean() + 1e-6, None)
        raw = np.where(pos, np.where(least < 30, np.log(np.expm1(np.minimum(least, 30))), least) if soft else np.log(least), start)

    def value(r):
        return np.where(pos, log1pexp(r) if soft else np.exp(np.clip(r, -40, 40)), r)

    def slope(r):
        return np.where(pos, expit(r), 1.0) if soft else np.where(pos, value(r), 1.0)

    def bend(r):
        return expit(r) * expit(-r) if soft else value(r)

    def objective(r, s):
        beta = value(r)
        return 0.5 * beta @ w.g @ beta - w.b @ beta + 0.5 * r @ s @ r

    for _ in range(control.outer):
        beta = value(raw)
        c = slope(raw)
        g = w.g * c[:, None] * c
        left = w.b - w.g @ beta
        rss = w.zz - 2 * beta @ w.b + beta @ w.g @ beta
        b = c * left + g @ raw
        zz = rss + 2 * raw @ (c * left) + raw @ g @ raw
        old = None if rho is None else rho.copy()
        rho = selector.select(Working(g + 1e-10 * np.trace(g) / len(g) * np.eye(len(g)), b, zz, w.n, w.scale), rho, newton=6)
        s = selector.penalty(rho)
        scale = w.scale or max(rss, 1e-300) / w.n
        moved = 0.0
        for _ in range(control.inner):
            beta = value(raw)
            c = slope(raw)
            left = w.b - w.g @ beta
            grad = s @ raw - c * left
            hess = w.g * c[:, None] * c + s
            hess[pos, pos] += np.maximum(-(bend(raw) * left)[pos], 0.0)  # the map's curvature, where it is safe
            step = -inverse(hess + 1e-9 * np.trace(hess) / len(hess) * np.eye(len(hess))) @ grad
            step = np.clip(step, -3, 3)
            now, size = objective(raw, s), 1.0
            while objective(raw + size * step, s) > now and size > 1e-6:
                size /= 2
            raw = raw + size * step
            moved = max(moved, float(np.abs(size * step).max()))
            if np.abs(size * step).max() < 1e-7:
                break
        if old is not None and np.abs(rho - old).max() < 1e-3:
            break
    del scale
    return raw, value(raw), slope(raw), rho, selector


def fit_constrained(design, rows, table, family, method: str, control: GamControl, n: int):
    """A fit with exponentials, or with linear constraints, or both kinds of smooths in one formula where the
    exponentials' signs are kept as inequalities."""
    family = replace(family)
    if not isinstance(control, ScamControl):
        control = ScamControl(control.epsilon, control.max_iterations, control.gamma, control.local_rows)
    response = design.formula.response
    ineq, eq = design.inequalities(), design.equalities()
    pos = design.positive()
    linear = ineq is not None or eq is not None
    if linear and pos.any():
        rows_of_signs = np.eye(design.p)[pos]
        ineq = (rows_of_signs, np.zeros(len(rows_of_signs))) if ineq is None else (np.vstack([ineq[0], rows_of_signs]), np.concatenate([ineq[1], np.zeros(len(rows_of_signs))]))
    direct = family.name == "normal" and family.link_name == "identity"
    beta = raw = rho = stats = None
    last, passes, converged = np.inf, 0, direct
    turn = c = None
    while passes < control.max_iterations:
        r = rows.sweep(working_pass(design, family, response, beta))
        passes += 1
        zz, dev, pearson, total_w, wy, n_used, _ = r["s"]
        if beta is not None:
            stats = r
            if abs(last - dev) < control.epsilon * (abs(dev) + 0.1):
                converged = True
                break
            last = dev
        w = Working(r["g"], r["b"], zz, n_used, 1.0 if family.known_scale else None)
        if linear:
            beta, rho, turn = _quadratic(design, w, method, control.gamma, ineq, eq, rho)
        else:
            raw, beta, c, rho, selector = _exponential(design, w, method, control, raw, rho)
        if direct:
            stats = r
            break
    selector = Selector(design, method, control.gamma)
    if linear:
        small = Selector(_Seen(design, turn), method, control.gamma)
        inv = turn @ inverse(turn.T @ (w.g + selector.penalty(rho)) @ turn) @ turn.T
        criterion = small.score(rho, Working(turn.T @ w.g @ turn, turn.T @ w.b, w.zz, w.n, w.scale))
        jac = np.ones(design.p)
    else:
        jac = c
        inv = inverse(w.g * c[:, None] * c + selector.penalty(rho) + 1e-12 * np.eye(design.p)) * c[:, None] * c
        criterion = float("nan")
    m = _finish(design, rows, table, family, selector, rho, beta, stats, w, n, passes, converged, direct)
    f = inv @ w.g
    m.edf = np.diag(f).copy()
    m.edf2 = 2 * m.edf - np.einsum("ij,ji->i", f, f)
    m.scale = 1.0 if family.known_scale else float(m.pearson / max(w.n - m.edf.sum(), 1e-6))
    m.vp, m.ve = inv * m.scale, f @ inv * m.scale
    m.raw_beta = raw
    if linear:
        m.criterion = float(criterion)
    else:
        rss = max(w.zz - 2 * beta @ w.b + beta @ w.g @ beta, 0.0)
        m.criterion = float(w.n * rss / max(w.n - m.edf.sum(), 1e-6) ** 2) if method.upper() == "GCV" else m.criterion
    del jac
    return m


def _quadratic(design, w: Working, method: str, gamma: float, ineq, eq, rho):
    """Coefficients under linear constraints; smoothing parameters are chosen on the space that the active
    constraints leave."""
    a, lo = ineq if ineq is not None else (None, None)
    e, d = eq if eq is not None else (None, None)
    selector = Selector(design, method, gamma)
    rho = selector.select(w, rho)
    turn = np.eye(design.p)
    active_before = None
    for _ in range(15):
        beta, active = solve_qp(w.g + selector.penalty(rho), w.b, a, lo, e, d)
        held = [m for m in (None if e is None else e, None if a is None or not len(active) else a[active]) if m is not None and len(m)]
        if held:
            _, s, vt = np.linalg.svd(np.vstack(held))
            turn = vt[int((s > 1e-9 * s[0]).sum()) :].T
        else:
            turn = np.eye(design.p)
        if active_before is not None and np.array_equal(active, active_before):
            break
        active_before = active
        small = Selector(_Seen(design, turn), method, gamma)
        # the constrained model around a feasible point
        base = beta - turn @ (turn.T @ beta)
        b = turn.T @ (w.b - w.g @ base)
        zz = w.zz - 2 * base @ w.b + base @ w.g @ base
        rho = small.select(Working(turn.T @ w.g @ turn, b, zz, w.n, w.scale), rho)
    return beta, rho, turn


def scam(formula, df, family=None, link=None, method: str = "GCV", **more):
    """A shape-constrained additive model; smoothing by GCV unless said otherwise. control: a ScamControl."""
    return gam(formula, df, family, link, method, **more)


def scasm(formula, df, family=None, link=None, method: str = "REML", **more):
    """An additive model under linear constraints (bases sc and scad, or point constraints pc)."""
    return gam(formula, df, family, link, method, **more)
