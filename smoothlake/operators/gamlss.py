"""Regression of several distribution parameters: ``gamlss`` and ``evgam``.

A pass gives the penalised likelihood's gradient and Hessian in blocks of predictors. Around the current
coefficients that is a linear model with known scale, whose smoothing parameters are chosen on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smoothlake.operators.gam import COUNT, GamControl, OFFSET, WEIGHT, _extra_columns, prepare
from smoothlake.operators.multifamilies import DISTRIBUTIONS, MultiFamily
from smoothlake.operators.rowmap import add_columns
from smoothlake.operators.smoothing import Selector, Working, inverse
from smoothlake.plans.design import Design, Penalty, bind
from smoothlake.plans.formula import Formula, parse
from smoothlake.sources.rows import SparkRows, row_counts, rows_of


@dataclass(frozen=True)
class GamlssControl:
    """cycles: most outer cycles. c_crit: change of the global deviance at which they end. sp_method: how each
    cycle chooses smoothing parameters (efs, local_ml, local_gaic, local_gcv); gaic_k: price of a freedom."""

    cycles: int = 60
    c_crit: float = 1e-6
    sp_method: str = "efs"
    gaic_k: float = 2.0


def gamlss_control(**options) -> GamlssControl:
    return GamlssControl(**options)


evgam_control = mp_control = gamlss_control


class Stacked:
    """The designs of several predictors side by side, as smoothing selection wants them."""

    def __init__(self, designs: list[Design], offsets: list[str | None] | None = None):
        self.designs = designs
        self.offsets = offsets or [None] * len(designs)
        self.starts = np.concatenate(([0], np.cumsum([d.p for d in designs]))).astype(int)
        self.p = int(self.starts[-1])
        self.penalties: list[Penalty] = []
        for d, at in zip(designs, self.starts, strict=False):
            for pen in d.penalties:
                self.penalties.append(Penalty([(slice(s.start + at, s.stop + at), m) for s, m in pen.blocks], pen.label, pen.fixed, pen.rank))

    def part(self, k: int) -> slice:
        return slice(self.starts[k], self.starts[k + 1])

    def unit(self, j: int) -> np.ndarray:
        s = np.zeros((self.p, self.p))
        for at, m in self.penalties[j].blocks:
            s[at, at] += m
        return s


def _selector(design, control: GamlssControl) -> Selector:
    if control.sp_method not in ("efs", "local_ml", "local_gaic", "local_gcv"):
        raise ValueError("sp_method is efs, local_ml, local_gaic or local_gcv")
    s = Selector(design, {"local_ml": "ML", "local_gaic": "UBRE", "local_gcv": "GCV"}.get(control.sp_method, "REML"))
    if control.sp_method == "local_gaic":
        s.gamma = control.gaic_k / 2
    return s


def predictors(stacked: Stacked, beta: np.ndarray, cols, xs=None) -> list[np.ndarray]:
    """The linear predictors of a block, with their offsets."""
    xs = [d.matrix(cols) for d in stacked.designs] if xs is None else xs
    etas = [x @ beta[stacked.part(i)] for i, x in enumerate(xs)]
    return [e if o is None else e + np.asarray(cols[o], float) for e, o in zip(etas, stacked.offsets, strict=True)]


def value_pass(stacked: Stacked, family: MultiFamily, response: str, beta: np.ndarray):
    """The negative log-likelihood alone: what a trial step needs."""

    def block(cols):
        f = family.nll_eta(np.asarray(cols[response], float), predictors(stacked, beta, cols))
        return {"s": np.array([(np.asarray(cols[WEIGHT], float) * f).sum()])}

    return block


def paired(df: DataFrame, keys: list[str], response: str, middle: float) -> DataFrame:
    """Rows with equal covariates as two, a deviation below and above their mean with half their weight each. A likelihood
    that is quadratic in the response, and its derivatives, have the same sums over both. middle: of the responses' range."""
    off, w = F.col(f"`{response}`") - F.lit(float(middle)), F.col(WEIGHT)
    sums = df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.sum(w).alias(WEIGHT), F.sum(w * off).alias("__y"), F.sum(w * off * off).alias("__yy"), F.count(F.lit(1)).alias(COUNT))
    some = F.col(WEIGHT) > 0
    mean = F.when(some, F.col("__y") / F.col(WEIGHT)).otherwise(0.0)
    away = F.when(some, F.sqrt(F.greatest(F.col("__yy") / F.col(WEIGHT) - mean * mean, F.lit(0.0)))).otherwise(0.0)
    both = F.explode(F.array(mean - away + F.lit(float(middle)), mean + away + F.lit(float(middle))))
    return sums.select(*[F.col(f"`{c}`") for c in keys], (F.col(WEIGHT) / 2).alias(WEIGHT), (F.col(COUNT) / 2).alias(COUNT), both.alias(response))


def rows_to_fit(df: DataFrame, n: int, formula: Formula, family: MultiFamily, spread: tuple[float, float], local_rows: int, offsets: list[str] = ()):
    """The rows; of a table that the driver may not hold, and a likelihood quadratic in the response, those with equal
    covariates together if that leaves few enough."""
    if n > local_rows and family.quadratic and not _extra_columns(formula):
        keys = list(dict.fromkeys([*(c for c in formula.columns if c != formula.response), OFFSET, *offsets]))
        small = paired(df, keys, formula.response, (spread[0] + spread[1]) / 2).persist(StorageLevel.MEMORY_AND_DISK)
        groups = small.count()
        if groups > local_rows and groups < n / 2:
            return SparkRows(small, groups, (small,))
        kept = rows_of(small, groups, local_rows) if groups <= local_rows else None
        small.unpersist()
        if kept is not None:
            return kept
    return rows_of(df, n, local_rows)


def likelihood_pass(stacked: Stacked, family: MultiFamily, response: str, beta: np.ndarray):
    designs, starts, p, k = stacked.designs, stacked.starts, stacked.p, len(stacked.designs)

    def block(cols):
        xs = [d.matrix(cols) for d in designs]
        y, w = np.asarray(cols[response], float), np.asarray(cols[WEIGHT], float)
        etas = predictors(stacked, beta, cols, xs)
        f, g, h = family.derivatives(y, etas)
        grad, hess = np.zeros(p), np.zeros((p, p))
        for i in range(k):
            a = slice(starts[i], starts[i + 1])
            grad[a] = xs[i].T @ (w * g[i])
            for j in range(i + 1):
                b = slice(starts[j], starts[j + 1])
                hess[a, b] = xs[i].T @ (xs[j] * (w * h[i][j])[:, None])
                hess[b, a] = hess[a, b].T
        return {"grad": grad, "hess": hess, "s": np.array([(w * f).sum(), row_counts(cols)[w > 0].sum()])}

    return block


def _definite(h: np.ndarray) -> np.ndarray:
    """The nearest curvature that is safely positive: negative directions are turned round."""
    d = 1 / np.sqrt(np.maximum(np.abs(np.diag(h)), 1e-8))
    value, vector = np.linalg.eigh(h * d[:, None] * d)
    value = np.maximum(np.abs(value), 1e-7 * max(np.abs(value).max(), 1.0))
    return (vector * value @ vector.T) / d[:, None] / d


def fit_stacked(stacked: Stacked, rows, family: MultiFamily, response: str, start: np.ndarray, control: GamlssControl, method: str = "efs", rho: np.ndarray | None = None, fixed: bool = False):
    """(beta, rho, curvature, nll, passes, converged): joint Newton steps (efs, cg), or one predictor after the
    other (rs); cg takes two rounds of rs first."""
    selector = _selector(stacked, control)
    beta, passes = start.copy(), 0
    k = len(stacked.designs)

    def sweep(b):
        return rows.sweep(likelihood_pass(stacked, family, response, b))

    r = sweep(beta)
    passes += 1
    nll = r["s"][0]
    rho = selector.start(_definite(r["hess"])) if rho is None else rho
    converged = False
    rounds = 0
    blocks = [slice(0, stacked.p)]
    while rounds < control.cycles and passes < 40 * k + 60:
        sequential = method == "rs" or (method == "cg" and rounds < 2)
        blocks = [stacked.part(i) for i in range(k)] if sequential else [slice(0, stacked.p)]
        before = nll
        moved = 0.0
        for at in blocks:
            h, g = np.zeros_like(r["hess"]), np.zeros(stacked.p)
            h[at, at], g[at] = _definite(r["hess"][at, at]), r["grad"][at]
            out = np.ones(stacked.p, bool)
            out[at] = False
            h[out, out] = 1.0  # predictors that stand still
            b = h @ beta - g
            n = r["s"][1]
            if not fixed:
                w = Working(h, b, float(b @ np.linalg.lstsq(h, b, rcond=None)[0]) + n, n, 1.0)
                keep = [j for j, pen in enumerate(stacked.penalties) if at.start <= pen.blocks[0][0].start < at.stop]
                new = selector.select(w, rho, newton=2) if keep else rho
                for j in keep:
                    moved = max(moved, abs(new[j] - rho[j]) if abs(new[j]) < 12 else 0.0)
                    rho[j] = new[j]
            s = selector.penalty(rho)
            step = inverse(h + s) @ b - beta
            step[out] = 0.0
            old = nll + 0.5 * beta @ s @ beta
            size = 1.0
            for attempt in range(14):
                trial = beta + size * step
                # the whole step is taken as a rule and needs its derivatives then; shorter ones are tried by value
                t = sweep(trial) if attempt == 0 else rows.sweep(value_pass(stacked, family, response, trial))
                passes += 1
                if np.isfinite(t["s"][0]) and t["s"][0] + 0.5 * trial @ s @ trial <= old + 1e-9 * (1 + abs(old)):
                    if attempt:
                        t, passes = sweep(trial), passes + 1
                    beta, r, nll = trial, t, t["s"][0]
                    break
                size /= 3
        rounds += 1
        if abs(before - nll) < control.c_crit * (abs(nll) + 0.1) and moved < 0.05 and rounds > 2:
            converged = True
            break
    return beta, rho, r["hess"], nll, passes, converged, selector


@dataclass
class MultiParameterModel:
    family: MultiFamily
    stacked: Stacked
    formula: list[Formula]
    beta: np.ndarray
    log_sp: np.ndarray
    vp: np.ndarray
    edf: np.ndarray
    nll: float
    laml: float
    n: int
    passes: int
    converged: bool
    table: DataFrame | None = field(default=None, repr=False)
    rows: Any = field(default=None, repr=False)

    def nparams(self) -> int:
        return self.family.nparams()

    def param_names(self):
        return self.family.param_names()

    def param_coef(self, name: str | int) -> np.ndarray:
        k = name if isinstance(name, int) else self.family.names.index(name)
        return self.beta[self.stacked.part(k)]

    def param_eta(self, name: str | int, newdata: DataFrame | None = None) -> DataFrame:
        """The table with ``eta``, the linear predictor of one parameter."""
        k = name if isinstance(name, int) else self.family.names.index(name)
        df, stacked, beta = self.table if newdata is None else newdata, self.stacked, self.beta

        def block(cols):
            eta = stacked.designs[k].matrix(cols) @ beta[stacked.part(k)]
            return {"eta": eta if stacked.offsets[k] is None else eta + np.asarray(cols[stacked.offsets[k]], float)}

        return add_columns(df, self.needed(), block, ["eta"])

    def coef(self):
        return self.beta

    def vcov(self):
        return self.vp

    def stderror(self):
        return np.sqrt(np.maximum(np.diag(self.vp), 0))

    def nobs(self):
        return self.n

    def model_edf(self) -> float:
        return float(self.edf.sum())

    def smooth_edf(self) -> dict[str, float]:
        return {f"{n}:{s.label}": float(self.edf[self.stacked.part(k)][s.slice].sum()) for k, n in enumerate(self.family.names) for s in self.stacked.designs[k].smooths}

    def loglikelihood(self) -> float:
        return -self.nll

    def deviance(self) -> float:
        return 2 * self.nll

    def aic(self) -> float:
        return 2 * self.nll + 2 * self.model_edf()

    def bic(self) -> float:
        return 2 * self.nll + np.log(self.n) * self.model_edf()

    def coeftable(self) -> DataFrame:
        out = []
        se = self.stderror()
        for k, name in enumerate(self.family.names):
            d, at = self.stacked.designs[k], self.stacked.starts[k]
            for i in range(d.n_parametric):
                b, e = float(self.beta[at + i]), float(se[at + i])
                out.append((name, d.names[i], b, e, b / e if e else float("nan")))
        return (self.table.sparkSession if self.table is not None else SparkSession.getActiveSession()).createDataFrame(out, "parameter string, term string, estimate double, std_error double, statistic double")

    def needed(self) -> list[str]:
        """The columns that a prediction reads, offsets among them."""
        return list(dict.fromkeys([*(c for f in self.formula for c in f.columns if c != f.response), *(o for o in self.stacked.offsets if o)]))

    def predict(self, newdata: DataFrame | None = None, type: str = "response", se: bool = False) -> DataFrame:
        """The table with a column per parameter (and ``<name>_se``), on the response or the link scale."""
        df = self.table if newdata is None else newdata
        stacked, beta, family, vp = self.stacked, self.beta, self.family, self.vp
        names = [*family.names, *([f"{n}_se" for n in family.names] if se else [])]
        from smoothlake.operators.families import link

        def block(cols):
            out = {}
            for k, n in enumerate(family.names):
                x = stacked.designs[k].matrix(cols)
                at = stacked.part(k)
                eta = x @ beta[at] if stacked.offsets[k] is None else x @ beta[at] + np.asarray(cols[stacked.offsets[k]], float)
                g = link(family.links[k])
                out[n] = g.inv(eta) if type == "response" else eta
                if se:
                    e = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, vp[at, at], x), 0))
                    out[f"{n}_se"] = e * np.abs(g.d1(eta)) if type == "response" else e
            return out

        return add_columns(df, self.needed(), block, names)

    def nll_rows(self, newdata: DataFrame | None = None) -> DataFrame:
        df = self.table if newdata is None else newdata
        stacked, beta, family = self.stacked, self.beta, self.family
        y = self.formula[0].response

        def block(cols):
            return {"nll": family.nll_eta(cols[y], predictors(stacked, beta, cols))}

        return add_columns(df, [*self.needed(), y], block, ["nll"])

    def summary(self) -> str:
        lines = [f"Family: {type(self.family).__name__}, n = {self.n}, -log L = {self.nll:.6g}, AIC = {self.aic():.6g}"]
        lines += [f"{k}: edf {v:.3f}" for k, v in self.smooth_edf().items()]
        return "\n".join(lines)

    __str__ = summary


def gamlss(formulas, df: DataFrame, family: MultiFamily | str, weights: str | None = None, method: str = "efs", control: GamControl = GamControl(), gamlss_ctrl: GamlssControl = GamlssControl(), na_action: str = "fail", start: list[float] | None = None, sp: list[float] | None = None, offset: str | list[str | None] | None = None) -> MultiParameterModel:
    """Fits a formula per parameter (one formula is used for all; later formulas may leave the response out).
    offset: a column that is added to the first predictor, or a list with one (or None) for each."""
    if isinstance(family, str):
        family = DISTRIBUTIONS[family.lower()]()
    if method not in ("efs", "rs", "cg"):
        raise ValueError("method is efs, rs or cg")
    given = [formulas] * family.nparams() if isinstance(formulas, (str, Formula)) else list(formulas)
    if len(given) != family.nparams():
        raise ValueError(f"{type(family).__name__} needs {family.nparams()} formulas ({', '.join(family.names)}), got {len(given)}")
    parsed = [parse(f) for f in given]
    response = parsed[0].response
    parsed = [Formula(response, f.parametric, f.intercept, f.smooths, f.random) for f in parsed]
    union = Formula(response, tuple(dict.fromkeys(t for f in parsed for t in f.parametric)), True, tuple(s for f in parsed for s in f.smooths))
    offsets = list(offset) if isinstance(offset, (list, tuple)) else [offset] + [None] * (family.nparams() - 1)
    if len(offsets) != family.nparams():
        raise ValueError(f"{type(family).__name__} takes {family.nparams()} offsets, got {len(offsets)}")
    narrow, n, ranges = prepare(df, union, weights, None, na_action, [o for o in offsets if o])
    problem = family.valid(*ranges[response])
    if problem:
        raise ValueError(problem)
    rows = rows_to_fit(narrow, n, union, family, ranges[response], control.local_rows, [o for o in offsets if o])
    designs = [bind(f, rows) for f in parsed]
    return _fit_model(designs, parsed, rows, narrow, family, response, n, method, gamlss_ctrl, start, ranges[response][0], sp, offsets)


def _fit_model(designs, parsed, rows, table, family, response, n, method, control, start=None, lo=0.0, sp=None, offsets=None) -> MultiParameterModel:
    stacked = Stacked(designs, offsets)
    m = rows.sweep(lambda cols: {"m": np.array([(cols[WEIGHT] * cols[response]).sum(), (cols[WEIGHT] * cols[response] ** 2).sum(), cols[WEIGHT].sum()])})["m"]
    mean = m[0] / m[2]
    etas = start or family.start(mean, float(np.sqrt(max(m[1] / m[2] - mean**2, 1e-12))), lo)
    beta = np.zeros(stacked.p)
    for k, e in enumerate(etas):
        if designs[k].formula.intercept:
            beta[stacked.starts[k]] = e
    rho = None if sp is None else np.log(np.asarray(sp, float))
    beta, rho, hess, nll, passes, converged, selector = fit_stacked(stacked, rows, family, response, beta, control, method, rho, sp is not None)
    h = _definite(hess)
    s = selector.penalty(rho)
    inv = inverse(h + s)
    edf = np.diag(inv @ h).copy()
    from smoothlake.operators.smoothing import log_det

    laml = nll + 0.5 * beta @ s @ beta + 0.5 * log_det(h + s) - 0.5 * selector.log_det_penalty(rho) - 0.5 * (stacked.p - selector.rank) * np.log(2 * np.pi)
    return MultiParameterModel(family, stacked, parsed, beta, rho, inv, edf, float(nll), float(laml), n, passes, converged, table, rows)


def evgam(formulas, df: DataFrame, family: MultiFamily | str, **more) -> MultiParameterModel:
    """Extreme-value regression: gamlss with joint steps."""
    return gamlss(formulas, df, family, **more)


def mp_laml(m: MultiParameterModel) -> float:
    return m.laml


__all__ = ["GamlssControl", "MultiFamily", "MultiParameterModel", "OFFSET", "evgam", "gamlss", "gamlss_control", "mp_laml"]
