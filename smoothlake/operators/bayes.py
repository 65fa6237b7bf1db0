"""Bayesian additive models. Gaussian ones are sampled by Gibbs steps from the Gram matrix, others by an
independence sampler around the penalised fit whose target needs one pass per block of proposals; variances of
the smooths have half-Student priors through the smoothing parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smoothlake.functions.special import normal_ppf
from smoothlake.operators.gam import GamControl, gam
from smoothlake.operators.model import GamModel
from smoothlake.operators.rowmap import add_columns
from smoothlake.operators.smoothing import Selector, inverse
from smoothlake.plans.formula import parse


@dataclass(frozen=True)
class PriorSpec:
    """b: (mean, sd) of unpenalised coefficients, by name where given; sds: (degrees, scale) of the half-Student
    priors of the smooths' deviations; sigma: scale of the half-normal prior of the residual deviation."""

    b: tuple[float, float] = (0.0, 10.0)
    sds: tuple[float, float] = (3.0, 2.5)
    sigma: float = 2.5
    phi: float = 5.0
    named: dict = field(default_factory=dict)

    def of(self, name: str) -> tuple[float, float]:
        return self.named.get(name, self.b)


def default_priors() -> PriorSpec:
    return PriorSpec()


def get_prior(formula, priors: PriorSpec = PriorSpec()) -> list[tuple[str, str, tuple]]:
    """(class, coefficient, prior) of what a formula's parameters would get."""
    f = parse(formula)
    rows = [("b", "(Intercept)", priors.of("(Intercept)"))] if f.intercept else []
    rows += [("b", t, priors.of(t)) for t in f.parametric]
    rows += [("sds", s.label, priors.sds) for s in f.smooths]
    return [*rows, ("sigma", "", (priors.sigma,))]


@dataclass
class BayesGamModel:
    """draws: chains x draws x coefficients."""

    gam: GamModel
    draws: np.ndarray
    sigma: np.ndarray
    log_sp: np.ndarray
    priors: PriorSpec
    accepted: float

    @property
    def flat(self) -> np.ndarray:
        return self.draws.reshape(-1, self.draws.shape[-1])

    def coef(self):
        return self.flat.mean(axis=0)

    def vcov(self):
        return np.cov(self.flat.T)

    def nobs(self):
        return self.gam.n

    def confint(self, level: float = 0.95):
        return np.quantile(self.flat, [(1 - level) / 2, (1 + level) / 2], axis=0).T

    def rhat(self) -> np.ndarray:
        c, n, _ = self.draws.shape
        w = self.draws.var(axis=1, ddof=1).mean(axis=0)
        b = self.draws.mean(axis=1).var(axis=0, ddof=1) if c > 1 else 0.0
        return np.sqrt((n - 1) / n + b / np.maximum(w, 1e-300))

    def coeftable(self) -> DataFrame:
        ci, r = self.confint(), self.rhat()
        rows = [(n, float(a), float(s), float(lo), float(hi), float(q)) for n, a, s, (lo, hi), q in zip(self.gam.design.names, self.coef(), self.flat.std(axis=0), ci, r, strict=True)]
        return self.gam._spark().createDataFrame(rows, "term string, estimate double, std_error double, lower double, upper double, rhat double")

    def posterior_samples(self, n: int | None = None) -> np.ndarray:
        return self.flat if n is None else self.flat[np.linspace(0, len(self.flat) - 1, n).astype(int)]


def bayes_gam(formula, df: DataFrame, family=None, priors: PriorSpec | bool = True, nsamples: int = 1000, nchains: int = 2, warmup: int = 300, seed: int = 1, weights=None, offset: str | None = None, control: GamControl = GamControl(), na_action: str = "fail") -> BayesGamModel:
    priors = PriorSpec() if priors is True else priors
    m = gam(formula, df, family, None, "REML", weights, offset, control, na_action)
    draws, sigmas, rhos, took = [], [], [], []
    for chain in range(nchains):
        rng = np.random.default_rng([seed, chain])
        step = _gibbs if m.family.name == "normal" and m.family.link_name == "identity" else _independence
        d, s, r, a = step(m, priors, nsamples, warmup, rng)
        draws.append(d)
        sigmas.append(s)
        rhos.append(r)
        took.append(a)
    return BayesGamModel(m, np.stack(draws), np.stack(sigmas), np.stack(rhos), priors, float(np.mean(took)))


def _prior_precision(m: GamModel, priors: PriorSpec):
    prec, mean = np.zeros(m.design.p), np.zeros(m.design.p)
    touched = sum((np.diag(m.design.unit(j)) for j in range(len(m.log_sp))), np.zeros(m.design.p)) > 0
    for i, name in enumerate(m.design.names):
        if not touched[i]:
            a, sd = priors.of(name)
            mean[i], prec[i] = a, 1 / sd**2
    return prec, mean


def _sp_step(m: GamModel, units, rho, beta, priors, rng, ranks):
    """Random-walk steps of the log smoothing parameters; a smooth's deviation is sd = exp(-rho / 2)."""
    nu, scale = priors.sds

    def target(j, r):
        sd = math.exp(-r / 2)
        return 0.5 * ranks[j] * r - 0.5 * math.exp(r) * float(beta @ units[j] @ beta) - (nu + 1) / 2 * math.log1p((sd / scale) ** 2 / nu) - r / 2

    for j in range(len(rho)):
        for _ in range(3):
            new = rho[j] + 0.8 * rng.standard_normal()
            if abs(new) < 25 and math.log(rng.uniform()) < target(j, new) - target(j, rho[j]):
                rho[j] = new
    return rho


def _gibbs(m: GamModel, priors, n, warmup, rng):
    """Coefficients, smoothing parameters and residual variance in turn; no pass over the rows."""
    prec, mean = _prior_precision(m, priors)
    # smoothing parameters here are on the coefficients' own scale, not relative to the residual variance
    units = [m.design.unit(j) for j in range(len(m.log_sp))]
    ranks = [p.rank for p in m.design.penalties]
    rho = m.log_sp - math.log(m.scale)
    s2, beta = m.scale, m.beta.copy()
    out, sig, rhos = np.zeros((n, m.design.p)), np.zeros(n), np.zeros((n, len(rho)))
    for it in range(n + warmup):
        a = m.gram / s2 + np.diag(prec) + sum((math.exp(r) * u for r, u in zip(rho, units, strict=True)), np.zeros_like(m.gram))
        inv = inverse(a)
        value, vector = np.linalg.eigh(inv)
        beta = inv @ (m.rhs / s2 + prec * mean) + vector @ (np.sqrt(np.maximum(value, 0)) * rng.standard_normal(len(beta)))
        rss = max(m.zz - 2 * beta @ m.rhs + beta @ m.gram @ beta, 1e-300)
        s2 = rss / rng.chisquare(m.n)  # flat in log sigma; the half-normal prior is weighed in by rejection
        if rng.uniform() > math.exp(-0.5 * min(s2 / priors.sigma**2, 50.0)) and s2 < priors.sigma**2:
            s2 = rss / rng.chisquare(m.n)
        rho = _sp_step(m, units, rho, beta, priors, rng, ranks)
        if it >= warmup:
            out[it - warmup], sig[it - warmup], rhos[it - warmup] = beta, math.sqrt(s2), rho
    return out, sig, rhos, 1.0


def log_likelihoods(m: GamModel, betas: np.ndarray) -> np.ndarray:
    """Log-likelihoods of many coefficient vectors in one pass."""
    design, family, y, scale = m.design, m.family, m.design.formula.response, m.scale

    def block(cols):
        x, w = design.matrix(cols), np.asarray(cols["__w"], float)
        out = np.zeros(len(betas))
        for i, b in enumerate(betas):
            mu = family.clip(family.link.inv(x @ b + cols["__offset"]))
            out[i] = family.loglik(np.asarray(cols[y], float), mu, w, scale).sum()
        return {"l": out}

    return m.rows.sweep(block)["l"]


def _independence(m: GamModel, priors, n, warmup, rng, block: int = 250):
    """Proposals from a Student distribution around the fit, weighed by the posterior at the fitted smoothing."""
    prec, mean = _prior_precision(m, priors)
    s = sum((math.exp(r) * m.design.unit(j) for j, r in enumerate(m.log_sp)), np.zeros_like(m.gram)) / m.scale
    value, vector = np.linalg.eigh((m.vp + m.vp.T) / 2)
    root = vector * np.sqrt(np.maximum(value, 0))
    nu, p = 8.0, m.design.p
    now, now_w, took = m.beta, None, 0
    out = []
    while len(out) < n + warmup:
        z = rng.standard_normal((block, p))
        g = rng.chisquare(nu, block) / nu
        z = z / np.sqrt(g)[:, None]
        proposal = m.beta + z @ root.T
        if now_w is None:
            proposal[0], z[0] = m.beta, 0.0
        target = log_likelihoods(m, proposal) - 0.5 * np.einsum("ij,jk,ik->i", proposal, s, proposal) - 0.5 * (prec * (proposal - mean) ** 2).sum(axis=1)
        w = target + (nu + p) / 2 * np.log1p((z**2).sum(axis=1) / nu)
        for b, v in zip(proposal, w, strict=True):
            if now_w is None or math.log(rng.uniform()) < v - now_w:
                now, now_w = b, v
                took += 1
            out.append(now)
    d = np.array(out[warmup : warmup + n])
    return d, np.full(n, math.sqrt(m.scale)), np.tile(m.log_sp, (n, 1)), took / len(out)


def _row_logliks(m: BayesGamModel, draws: int):
    g = m.gam
    design, family, y, scale = g.design, g.family, g.design.formula.response, g.scale
    betas = m.posterior_samples(draws)
    sigma = m.sigma.ravel()[np.linspace(0, m.sigma.size - 1, draws).astype(int)]

    def rows(cols):
        x, w = design.matrix(cols), np.asarray(cols["__w"], float)
        yy = np.asarray(cols[y], float)
        out = np.zeros((len(yy), draws))
        for i, b in enumerate(betas):
            mu = family.clip(family.link.inv(x @ b + cols["__offset"]))
            out[:, i] = family.loglik(yy, mu, w, sigma[i] ** 2 if family.name == "normal" else scale)
        return out

    return rows, y


def pointwise_loglikelihood(m: BayesGamModel, draws: int = 200) -> DataFrame:
    """The table with ``log_lik``, an array over draws."""
    f, y = _row_logliks(m, draws)
    needed = list(dict.fromkeys([*m.gam.needed(), y, "__w", "__offset"]))
    return add_columns(m.gam.table, needed, lambda cols: {"log_lik[]": f(cols)}, ["log_lik[]"], m.gam._numeric() | {y})


def pareto_smoothed(logw: np.ndarray) -> tuple[np.ndarray, float]:
    """Smoothed log importance weights of one row and the shape of their tail, by the posterior-mean estimate of a
    generalised Pareto fit over a grid of scales."""
    s = len(logw)
    logw = logw - logw.max()
    tail = int(min(0.2 * s, 3 * math.sqrt(s)))
    if tail < 5:
        return logw, float("inf")
    order = np.argsort(logw)
    cut = logw[order[-tail - 1]]
    x = np.exp(logw[order[-tail:]]) - math.exp(cut)
    if x[-1] <= 0:
        return logw, 0.0
    x = np.maximum(x, 1e-300)
    grid = 30 + int(math.sqrt(tail))
    j = np.arange(1, grid + 1)
    theta = 1 / x[-1] + (1 - np.sqrt(grid / (j - 0.5))) / (3 * x[int(tail / 4 + 0.5) - 1])
    k = np.array([np.mean(np.log1p(-t * x)) for t in theta])
    profile = tail * (np.log(-theta / k) - k - 1)
    weight = 1 / np.exp(profile[None, :] - profile[:, None]).sum(axis=1)
    t = float((theta * weight).sum() / weight.sum())
    shape = float(np.mean(np.log1p(-t * x)))
    scale = -shape / t
    shape = (tail * shape + 5.0) / (tail + 10.0)
    p = (np.arange(1, tail + 1) - 0.5) / tail
    q = scale / shape * np.expm1(-shape * np.log1p(-p)) if abs(shape) > 1e-9 else -scale * np.log1p(-p)
    out = logw.copy()
    out[order[-tail:]] = np.log(np.maximum(q + math.exp(cut), 1e-300))
    return np.minimum(out, 0.0), shape


def _scores(m: BayesGamModel, draws: int, kind: str) -> DataFrame:
    """elpd, p and pareto_k per row."""
    f, y = _row_logliks(m, draws)
    needed = list(dict.fromkeys([*m.gam.needed(), y, "__w", "__offset"]))

    def block(cols):
        ll = f(cols)
        top = ll.max(axis=1, keepdims=True)
        lppd = np.log(np.exp(ll - top).mean(axis=1)) + top[:, 0]
        k = np.zeros(len(ll))
        if kind == "waic":
            p = ll.var(axis=1, ddof=1)
            return {"elpd": lppd - p, "p": p, "pareto_k": k}
        elpd = np.zeros(len(ll))
        for i, row in enumerate(ll):
            w = -row - (-row).max()
            if kind == "psis":
                w, k[i] = pareto_smoothed(w)
            e = np.exp(w - w.max())
            a = row.max()
            elpd[i] = math.log((e * np.exp(row - a)).sum() / e.sum()) + a
        return {"elpd": elpd, "p": lppd - elpd, "pareto_k": k}

    return add_columns(m.gam.table, needed, block, ["elpd", "p", "pareto_k"], m.gam._numeric() | {y})


@dataclass
class Score:
    elpd: float
    p: float
    se: float
    ic: float
    rows: Any = field(repr=False, default=None)

    def pareto_k_diagnostic(self, edges=(0.5, 0.7, 1.0)) -> dict[str, int]:
        k = F.col("pareto_k")
        r = self.rows.agg(F.sum((k <= edges[0]).cast("int")), F.sum(((k > edges[0]) & (k <= edges[1])).cast("int")), F.sum(((k > edges[1]) & (k <= edges[2])).cast("int")), F.sum((k > edges[2]).cast("int"))).first()
        return dict(zip(("good", "ok", "bad", "very bad"), (int(v or 0) for v in r), strict=True))


def _score(rows: DataFrame) -> Score:
    e, p, v, n = rows.agg(F.sum("elpd"), F.sum("p"), F.variance("elpd"), F.count(F.lit(1))).first()
    return Score(e, p, math.sqrt(n * (v or 0.0)), -2 * e, rows)


def waic(m: BayesGamModel, draws: int = 400) -> Score:
    return _score(_scores(m, draws, "waic"))


def loo(m: BayesGamModel, draws: int = 400) -> Score:
    """Leave-one-out by Pareto-smoothed importance sampling."""
    return _score(_scores(m, draws, "psis"))


psis_loo = loo


def is_loo(m: BayesGamModel, draws: int = 400) -> Score:
    return _score(_scores(m, draws, "is"))


def pareto_k_diagnostic(s: Score) -> dict[str, int]:
    return s.pareto_k_diagnostic()


def ginla(m: GamModel, coefficients: list[int] | None = None, nk: int = 16, nb: int = 100) -> DataFrame:
    """coef, beta, density: marginal posteriors by Laplace's approximation along each coefficient. The other
    coefficients follow their conditional mean; the likelihood at all grid points of all coefficients takes one
    pass, its curvature is that of the fit."""
    which = list(range(m.design.p)) if coefficients is None else coefficients
    sd = m.stderror()
    s = Selector(m.design, m.method if m.method in ("REML", "ML") else "REML").penalty(m.log_sp) / m.scale
    t = np.linspace(-4, 4, nk)
    betas = np.concatenate([m.beta + t[:, None] * (m.vp[:, i] / max(sd[i], 1e-300)) for i in which])
    if m.family.name == "normal":
        ll = -0.5 * (m.zz - 2 * betas @ m.rhs + np.einsum("ij,jk,ik->i", betas, m.gram, betas)) / m.scale
    else:
        ll = log_likelihoods(m, betas)
    lp = (ll - 0.5 * np.einsum("ij,jk,ik->i", betas, s, betas)).reshape(len(which), nk)
    rows = []
    for i, v in zip(which, lp, strict=True):
        grid = np.linspace(-4, 4, nb)
        # the log density is the normal one plus a smooth remainder
        rest = np.interp(grid, t, v - v.max() + 0.5 * t * t)
        d = np.exp(rest - 0.5 * grid * grid)
        x = m.beta[i] + grid * sd[i]
        d /= max(float(((d[1:] + d[:-1]) / 2 * np.diff(x)).sum()), 1e-300)
        rows += [(i, float(a), float(b)) for a, b in zip(x, d, strict=True)]
    return m._spark().createDataFrame(rows, "coef int, beta double, density double")


__all__ = ["BayesGamModel", "PriorSpec", "bayes_gam", "default_priors", "get_prior", "ginla", "is_loo", "loo", "normal_ppf", "pa", "pareto_k_diagnostic", "pointwise_loglikelihood", "psis_loo", "waic"]
