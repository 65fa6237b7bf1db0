"""Quantile additive models: the smoothed pinball loss with a calibrated learning rate."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smoothlake.functions.special import binomial_ppf, expit, normal_ppf
from smoothlake.operators.gam import WEIGHT, GamControl, fit_design, prepare
from smoothlake.operators.families import Normal
from smoothlake.operators.gamlss import GamlssControl, MultiParameterModel, _definite, _fit_model, gamlss
from smoothlake.operators.multifamilies import ELF, ELFLSS
from smoothlake.operators.rowmap import add_columns
from smoothlake.operators.smoothing import Selector, inverse
from smoothlake.plans.design import bind
from smoothlake.plans.formula import parse
from smoothlake.sources.rows import rows_of


@dataclass
class QgamModel(MultiParameterModel):
    qu: float = 0.5
    lsig: float = 0.0
    co: float = 1.0

    def predict(self, newdata=None, type="response", se=False):
        out = super().predict(newdata, type, se).withColumnRenamed("mu", "fit")
        return out.withColumnRenamed("mu_se", "se_fit") if se else out

    def deviance_explained(self) -> float:
        """One less the ratio of pinball losses: of the fit and of the plain quantile."""
        y = self.formula[0].response
        fit = self.predict(self.table)
        q = self.table.agg(F.percentile_approx(y, self.qu, 100_000)).first()[0]
        a, b = fit.agg(F.sum(pinball("fit", y, self.qu)), F.sum(pinball(F.lit(q), y, self.qu))).first()
        return 1 - a / b

ROW = "__row"  # the number of a row, for bootstraps


def pinball(fit, y, qu: float):
    """The pinball loss as a column."""
    fit = F.col(fit) if isinstance(fit, str) else fit
    y = F.col(y) if isinstance(y, str) else y
    return F.when(y < fit, (1 - qu) * (fit - y)).otherwise(qu * (y - fit))


def pinball_loss(df: DataFrame, y: str, fit: str, qu: float, reduce: bool = True):
    """The summed pinball loss, or the table with a column ``loss``."""
    return float(df.agg(F.sum(pinball(fit, y, qu))).first()[0]) if reduce else df.withColumn("loss", pinball(fit, y, qu))


def default_err(n: int, qu: float) -> float:
    """Relative bandwidth: wide enough for few rows, but narrow enough that smoothing moves no quantile much."""
    return float(np.clip(5 / (math.sqrt(n) * min(qu, 1 - qu)), 0.01, 0.05))


def bootstrap_weights(rows: np.ndarray, b: int, seed: int) -> np.ndarray:
    """Poisson(1) counts, ``b`` for each row, from a hash of the row's number: rows of equal values are drawn apart."""
    h = np.ascontiguousarray(rows).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out = np.zeros((len(h), b))
        steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
        for i in range(b):
            u = (h + np.uint64(seed * 1000 + i + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            u ^= u >> np.uint64(27)
            u *= np.uint64(0x94D049BB133111EB)
            out[:, i] = np.searchsorted(steps, (u >> np.uint64(11)).astype(float) / 2**53)
    return out


def _calibrate(design, rows, response, qu, co, centre, rho, b: int = 20, seed: int = 1) -> float:
    """The log learning rate with the least out-of-bag pinball loss, by golden section over centre +- 3; a pass
    carries all bootstrap fits at once."""
    k = design.p

    def loss(lsig: float) -> float:
        family = ELF(qu, co, lsig)
        s = Selector(design, "REML").penalty(rho)
        betas = np.zeros((k, b))
        betas[0] = centre[1]
        value = np.inf
        for it in range(8):

            def block(cols, betas=betas):
                x, y = design.matrix(cols), np.asarray(cols[response], float)
                w = bootstrap_weights(cols[ROW], b, seed) * np.asarray(cols[WEIGHT], float)[:, None]
                out = {"g": np.zeros((b, k, k)), "r": np.zeros((b, k)), "l": np.zeros(b), "f": np.zeros(b)}
                for i in range(b):
                    f, g, h = family.derivatives(y, [x @ betas[:, i]])
                    out["g"][i] = x.T @ (x * (w[:, i] * np.maximum(h[0][0], 1e-4 / co))[:, None])
                    out["r"][i] = x.T @ (w[:, i] * g[0])
                    out["f"][i] = (w[:, i] * f).sum()
                    z = y - x @ betas[:, i]
                    out["l"][i] = (np.where(z < 0, (qu - 1) * z, qu * z) * (w[:, i] == 0)).sum()
                return out

            r = rows.sweep(block)
            moved = 0.0
            value = float(r["l"].sum())
            for i in range(b):
                step = -inverse(r["g"][i] + s) @ (r["r"][i] + s @ betas[:, i])
                betas[:, i] += step
                moved = max(moved, float(np.abs(step).max()))
            if moved < 1e-4 * (1 + np.abs(betas).max()):
                break
        return value

    lo, hi = centre[0] - 3, centre[0] + 3
    ratio = (math.sqrt(5) - 1) / 2
    a, c = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fc = loss(a), loss(c)
    for _ in range(7):
        if fa < fc:
            hi, c, fc = c, a, fa
            a = hi - ratio * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, c, fc
            c = lo + ratio * (hi - lo)
            fc = loss(c)
    return (lo + hi) / 2


def qgam(formula, df: DataFrame, qu: float, lsig: float | None = None, err: float | None = None, weights: str | None = None, control: GamControl = GamControl(), na_action: str = "fail") -> QgamModel:
    """Fits the quantile ``qu``. Two formulas give the learning rate a model of its own."""
    if not 0 < qu < 1:
        raise ValueError("a quantile lies in (0, 1)")
    if isinstance(formula, (list, tuple)):
        base = qgam(formula[0], df, qu, lsig if lsig is not None else 0.0, err, weights, control, na_action)
        return gamlss(list(formula), df, ELFLSS(qu, base.co), weights=weights, control=control, na_action=na_action)
    f = parse(formula)
    narrow, n, _ = prepare(df, f, weights, None, na_action)
    rows = rows_of(narrow.withColumn(ROW, F.monotonically_increasing_id()), n, control.local_rows)
    design = bind(f, rows)
    gauss = fit_design(design, rows, narrow, Normal(), "REML", control, n)
    var = max(gauss.scale, 1e-12)
    err = default_err(n, qu) if err is None else err
    co = err * math.sqrt(2 * math.pi * var) / (2 * math.log(2))
    if lsig is None:
        lsig = _calibrate(design, rows, f.response, qu, co, (0.5 * math.log(var), float(gauss.beta[0] + math.sqrt(var) * float(normal_ppf(qu)))), gauss.log_sp)
    m = _fit_model([design], [f], rows, narrow, ELF(qu, co, lsig), f.response, n, "efs", GamlssControl(), [float(gauss.beta[0]) + math.sqrt(var) * float(normal_ppf(qu))])
    return QgamModel(**m.__dict__, qu=qu, lsig=lsig, co=co)


def mqgam(formula, df: DataFrame, qu: list[float], **more) -> dict[float, QgamModel]:
    """A fit per quantile."""
    return {q: qgam(formula, df, q, **more) for q in qu}


def qdo(models: dict[float, QgamModel], qu: float, f=None, *args, **more):
    """One of several fits, or what ``f`` makes of it."""
    m = models[min(models, key=lambda q: abs(q - qu))]
    return m if f is None else f(m, *args, **more)


def cqcheck_table(df: DataFrame, x: str, y: str, fit: str, qu: float, bins: int = 10, level: float = 0.95) -> DataFrame:
    """bin, bin_lo, bin_mid, bin_hi, proportion, bin_size, ci_lower, ci_upper, flagged: the share of responses under
    the fit in equal bins of ``x``, against binomial limits."""
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    step = (hi - lo) / bins or 1.0
    number = F.least(F.floor((F.col(x) - F.lit(lo)) / F.lit(step)), F.lit(bins - 1)).cast("int")
    t = df.groupBy(number.alias("bin")).agg(F.avg((F.col(y) < F.col(fit)).cast("double")).alias("proportion"), F.count(F.lit(1)).alias("bin_size"))
    rows = []
    for r in t.collect():  # a row per bin
        a, b = (binomial_ppf(q, r.bin_size, qu) / r.bin_size for q in ((1 - level) / 2, (1 + level) / 2))
        rows.append((r.bin, lo + r.bin * step, lo + (r.bin + 0.5) * step, lo + (r.bin + 1) * step, r.proportion, r.bin_size, a, b, not a <= r.proportion <= b))
    return df.sparkSession.createDataFrame(sorted(rows), "bin int, bin_lo double, bin_mid double, bin_hi double, proportion double, bin_size long, ci_lower double, ci_upper double, flagged boolean")


def cqcheck(m: QgamModel, x: str, newdata: DataFrame | None = None, bins: int = 10, level: float = 0.95) -> DataFrame:
    return cqcheck_table(m.predict(newdata), x, m.formula[0].response, "fit", m.qu, bins, level)


def check_qgam(m: QgamModel, x: str | None = None) -> dict:
    """The share of responses under the fit, the bias that smoothing adds, and a binned check."""
    y = m.formula[0].response
    fit = m.predict()
    share = fit.agg(F.avg((F.col(y) < F.col("fit")).cast("double"))).first()[0]
    co = m.co
    smooth = fit.agg(F.avg(1 / (1 + F.exp((F.col(y) - F.col("fit")) / co)))).first()[0]
    x = x or m.formula[0].smooths[0].vars[0]
    return {"proportion": share, "expected": m.qu, "smoothing_bias": abs(smooth - share), "cqcheck": cqcheck_table(fit, x, y, "fit", m.qu)}


def quantile_residuals(m: QgamModel, newdata: DataFrame | None = None) -> DataFrame:
    """The table with ``resid``: the normal quantile of each response's place in the fitted loss density."""
    df = m.table if newdata is None else newdata
    design, beta, qu, co = m.stacked.designs[0], m.beta, m.qu, m.co
    y = m.formula[0].response

    def block(cols):
        z = (np.asarray(cols[y], float) - design.matrix(cols) @ beta) / co
        below = expit(z)
        # mass under the fit is the quantile itself
        p = np.where(z < 0, 2 * qu * below, qu + (1 - qu) * (2 * below - 1))
        return {"resid": normal_ppf(np.clip(p, 1e-12, 1 - 1e-12))}

    return add_columns(df, [*m.needed(), y], block, ["resid"])


__all__ = ["QgamModel", "check_qgam", "cqcheck", "mqgam", "pinball", "pinball_loss", "qdo", "qgam", "quantile_residuals", "_definite"]
