"""Posterior draws for models with several parameters, shape constraints, random effects and responses of any family.

Coefficients move by Hamiltonian trajectories in the metric of the penalised fit. All chains make their steps together: a
leapfrog step is one pass over the rows that gives every chain's likelihood and gradient, whatever the number of chains.
Where the likelihood is quadratic in the response, rows with equal covariates go together first, as two (``paired``).
Smoothing parameters (and with them the variances of random effects) move between trajectories by random-walk steps
that need the coefficients alone. Dispersions are coefficients of a predictor of their own and move with the others.

Shape-constrained coefficients are exponentials of what is sampled, as in the fit. Steps are sized during the warm-up,
for four of five trajectories to be accepted, and held from then on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from smoothlake.operators.bayes import PriorSpec
from smoothlake.operators.families import Family, family_of
from smoothlake.operators.gam import GamControl, WEIGHT, prepare
from smoothlake.operators.gamlss import GamlssControl, MultiParameterModel, Stacked, _definite, fit_stacked, likelihood_pass, predictors, rows_to_fit
from smoothlake.operators.gamm import random_smooths, with_groups
from smoothlake.operators.general import FAMILIES, eta_derivatives
from smoothlake.operators.multifamilies import BAD, BetaLS, GammaLS, GaussianLS, InverseGaussianLS, MultiFamily, NegBinLS
from smoothlake.operators.rowmap import add_columns
from smoothlake.operators.smoothing import Selector, inverse
from smoothlake.plans.design import bind
from smoothlake.plans.formula import Formula, parse


@dataclass(frozen=True)
class HmcControl:
    """steps: least and most leapfrog steps of a trajectory. accept: share of trajectories to be accepted. moves:
    random-walk steps of each smoothing parameter between trajectories."""

    steps: tuple[int, int] = (4, 8)
    accept: float = 0.8
    moves: int = 4


class OneParameter(MultiFamily):
    """A family without a dispersion as one with a single predictor."""

    names = ("mu",)

    def __init__(self, family: Family):
        self.family, self.links = family, (family.link_name,)

    def nll(self, y, mu):
        return self.family.deviance(y, self.family.clip(mu), np.ones(len(y))) / 2

    def derivatives(self, y, etas):
        mu = self.family.clip(self.family.link.inv(etas[0]))
        l1, l2, _ = eta_derivatives(self.family, y, mu, etas[0], np.ones(len(y)))
        return self.family.deviance(y, mu, np.ones(len(y))) / 2, [-l1], [[-l2]]

    def start(self, mean, sd, lo):
        return [float(self.family.link.g(self.family.clip(np.array([max(mean, 1e-3)]) if self.family.name == "poisson" else np.array([mean])))[0])]

    def valid(self, lo, hi):
        return self.family.valid(lo, hi)


def with_dispersion(family: Family) -> MultiFamily:
    """The family with its dispersion as a predictor of its own, if it has one."""
    if family.name in FAMILIES and family.known_scale:
        return OneParameter(family)
    several = {"normal": GaussianLS, "gamma": GammaLS, "inverse_gaussian": InverseGaussianLS, "negative_binomial": NegBinLS, "beta": BetaLS}
    if family.name not in several:
        raise ValueError(f"no sampler for the family {family.name}")
    return several[family.name]((family.link_name, "log"))


@dataclass
class BayesModel:
    """draws: chains x draws x coefficients, as sampled (before the exponential of constrained ones)."""

    fit: MultiParameterModel
    positive: np.ndarray
    draws: np.ndarray
    log_sp: np.ndarray
    priors: PriorSpec
    accepted: float
    passes: int
    names: list[str] = field(default_factory=list)

    @property
    def coefficients(self) -> np.ndarray:
        """All draws of the coefficients that multiply the columns."""
        flat = self.draws.reshape(-1, self.draws.shape[-1])
        return np.where(self.positive, np.exp(np.minimum(flat, 300)), flat)

    def coef(self) -> np.ndarray:
        return self.coefficients.mean(axis=0)

    def vcov(self) -> np.ndarray:
        return np.cov(self.coefficients.T)

    def confint(self, level: float = 0.95) -> np.ndarray:
        return np.quantile(self.coefficients, [(1 - level) / 2, (1 + level) / 2], axis=0).T

    def rhat(self) -> np.ndarray:
        """Of split chains, for coefficients and log smoothing parameters."""
        all_ = np.concatenate([self.draws, self.log_sp], axis=2)
        half = all_.shape[1] // 2
        x = np.concatenate([all_[:, :half], all_[:, half : 2 * half]])
        within, between = x.var(axis=1, ddof=1).mean(axis=0), x.mean(axis=1).var(axis=0, ddof=1)
        return np.sqrt((half - 1) / half + between / np.maximum(within, 1e-300))

    def coeftable(self) -> DataFrame:
        ci, r = self.confint(), self.rhat()
        rows = [(n, float(a), float(d), float(lo), float(hi), float(q)) for n, a, d, (lo, hi), q in zip(self.names, self.coef(), self.coefficients.std(axis=0), ci, r, strict=False)]
        return self.fit.table.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, lower double, upper double, rhat double")

    def posterior_samples(self, n: int | None = None) -> np.ndarray:
        flat = self.coefficients
        return flat if n is None else flat[np.linspace(0, len(flat) - 1, n).astype(int)]

    def predict(self, newdata: DataFrame | None = None, parameter: int = 0, draws: int = 200, level: float = 0.95) -> DataFrame:
        """The table with ``fit``, ``lower`` and ``upper`` of one parameter's linear predictor, over draws."""
        df, stacked, betas = self.fit.table if newdata is None else newdata, self.fit.stacked, self.posterior_samples(draws)

        def block(cols):
            etas = np.stack([predictors(stacked, b, cols)[parameter] for b in betas])
            lo, hi = np.quantile(etas, [(1 - level) / 2, (1 + level) / 2], axis=0)
            return {"fit": etas.mean(axis=0), "lower": lo, "upper": hi}

        return add_columns(df, self.fit.needed(), block, ["fit", "lower", "upper"])


class Posterior:
    """Log density and gradient of the sampled coefficients of all chains at once."""

    def __init__(self, stacked: Stacked, rows, family: MultiFamily, response: str, priors: PriorSpec, positive: np.ndarray):
        self.stacked, self.rows, self.family, self.response, self.positive = stacked, rows, family, response, positive
        self.selector, self.priors, self.passes = Selector(stacked, "REML"), priors, 0
        touched = sum((np.diag(u) for u in self.selector.units), np.zeros(stacked.p)) > 0
        self.names = [f"{n}:{c}" if len(stacked.designs) > 1 else c for n, d in zip(family.names, stacked.designs, strict=True) for c in d.names]
        self.mean, self.precision = np.zeros(stacked.p), np.zeros(stacked.p)
        for i, name in enumerate(self.names):
            if not touched[i]:
                at, sd = priors.of(name)
                self.mean[i], self.precision[i] = at, 1 / sd**2

    def coefficients(self, raw: np.ndarray) -> np.ndarray:
        return np.where(self.positive, np.exp(np.minimum(raw, 300)), raw)

    def likelihood(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood, gradient) of every chain, in one pass."""
        stacked, family, response = self.stacked, self.family, self.response
        betas = self.coefficients(raw)

        def block(cols):
            xs = [d.matrix(cols) for d in stacked.designs]
            y, w = np.asarray(cols[response], float), np.asarray(cols[WEIGHT], float)
            value, grad = np.zeros(len(betas)), np.zeros(betas.shape)
            for c, beta in enumerate(betas):
                f, g, _ = family.derivatives(y, predictors(stacked, beta, cols, xs))
                value[c] = -(w * f).sum()
                for i, x in enumerate(xs):
                    grad[c, stacked.part(i)] = -(x.T @ (w * g[i]))
            return {"v": value, "g": grad}

        self.passes += 1
        r = self.rows.sweep(block)
        return r["v"], np.where(self.positive, r["g"] * betas, r["g"])

    def density(self, raw: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, grad = self.likelihood(raw)
        for c, (b, r) in enumerate(zip(raw, rho, strict=True)):
            sb, off = self.selector.penalty(r) @ b, b - self.mean
            value[c] -= 0.5 * b @ sb + 0.5 * (self.precision * off * off).sum()
            grad[c] -= sb + self.precision * off
        return value, grad

    def move_smoothing(self, raw: np.ndarray, rho: np.ndarray, moves: int, rng) -> np.ndarray:
        """Random-walk steps of one chain's log smoothing parameters; a smooth's deviation is exp(-rho / 2)."""
        nu, scale = self.priors.sds
        squares = [float(raw @ u @ raw) for u in self.selector.units]

        def target(r):
            prior = sum(-(nu + 1) / 2 * np.log1p(np.exp(-r[j]) / scale**2 / nu) - r[j] / 2 for j in self.selector.free)
            return 0.5 * self.selector.log_det_penalty(r) - 0.5 * sum(np.exp(a) * q for a, q in zip(r, squares, strict=True)) + prior

        now = target(rho)
        for _ in range(moves):
            for j in self.selector.free:
                new = rho.copy()
                new[j] += 1.2 * rng.standard_normal()
                then = target(new) if abs(new[j]) < 25 else -np.inf
                if np.log(rng.uniform()) < then - now:
                    rho, now = new, then
        return rho


def sample(post: Posterior, center: np.ndarray, cov: np.ndarray, rho: np.ndarray, n: int, chains: int, warmup: int, seed: int, control: HmcControl):
    """(draws, log smoothing parameters, share accepted) by trajectories that all chains make together."""
    value, vector = np.linalg.eigh((cov + cov.T) / 2)
    root = vector * np.sqrt(np.maximum(value, 1e-12 * value.max()))  # raw = center + root z
    rng = np.random.default_rng(seed)
    raw = center + 0.5 * rng.standard_normal((chains, len(center))) @ root.T
    rhos = np.tile(rho, (chains, 1))
    draws, smooth = np.zeros((chains, n, len(center))), np.zeros((chains, n, len(rho)))
    size, mean_log, took = 0.4, [], []
    for turn in range(n + warmup):
        rhos = np.stack([post.move_smoothing(b, r, control.moves, rng) for b, r in zip(raw, rhos, strict=True)])
        start_value, grad = post.density(raw, rhos)
        p = rng.standard_normal(raw.shape)
        before, at, g = start_value - 0.5 * (p * p).sum(axis=1), raw.copy(), grad
        length = int(rng.integers(control.steps[0], control.steps[1] + 1))
        for _ in range(length):
            p = p + 0.5 * size * g @ root
            at = at + size * p @ root.T
            v, g = post.density(at, rhos)
            p = p + 0.5 * size * g @ root
        gain = np.where(v > -BAD / 2, v - 0.5 * (p * p).sum(axis=1) - before, -np.inf)
        gain = np.where(np.isfinite(gain), gain, -np.inf)
        accept = np.log(rng.uniform(size=chains)) < gain
        raw[accept] = at[accept]
        rate = float(np.exp(np.minimum(gain, 0)).mean())
        if turn < warmup:
            size = float(np.clip(size * np.exp((rate - control.accept) / (1 + turn) ** 0.4), 1e-4, 1.5))
            mean_log.append(np.log(size))
            if turn == warmup - 1:
                size = float(np.exp(np.mean(mean_log[warmup // 2 :])))
        else:
            draws[:, turn - warmup], smooth[:, turn - warmup] = raw, rhos
            took.append(rate)
    return draws, smooth, float(np.mean(took))


def bayes(formulas, df: DataFrame, family=None, priors: PriorSpec = PriorSpec(), nsamples: int = 500, nchains: int = 4, warmup: int = 250, seed: int = 1, weights: str | None = None, na_action: str = "fail", control: HmcControl = HmcControl(), gam_control: GamControl = GamControl()) -> BayesModel:
    """Posterior of a model: a formula per parameter (``gamlss``), or one formula whose family's dispersion is then a
    constant predictor. Formulas may hold shape-constrained smooths and random terms ``(1 | group)``, ``(x | group)``."""
    fam = family if isinstance(family, MultiFamily) else with_dispersion(family_of(family))
    given = [formulas] if isinstance(formulas, (str, Formula)) else list(formulas)
    parsed = [parse(f) for f in given]
    response = parsed[0].response
    parsed += [Formula(response, (), True, ()) for _ in range(fam.nparams() - len(parsed))] if len(parsed) == 1 else []
    if len(parsed) != fam.nparams():
        raise ValueError(f"{type(fam).__name__} needs {fam.nparams()} formulas, got {len(parsed)}")
    keyed = with_groups(df, tuple(r for f in parsed for r in f.random))
    full = []
    for f in parsed:  # random effects are ridge-penalised columns of their levels
        full.append(Formula(response, f.parametric, f.intercept, (*f.smooths, *random_smooths(f.random))))
    union = Formula(response, tuple(dict.fromkeys(t for f in full for t in f.parametric)), True, tuple(x for f in full for x in f.smooths))
    narrow, n, ranges = prepare(keyed, union, weights, None, na_action)
    if problem := fam.valid(*ranges[response]):
        raise ValueError(problem)
    rows = rows_to_fit(narrow, n, union, fam, ranges[response], gam_control.local_rows)
    stacked = Stacked([bind(f, rows) for f in full])
    positive = np.concatenate([d.positive() for d in stacked.designs])
    post = Posterior(stacked, rows, fam, response, priors, positive)
    beta, rho, hess, nll, passes, converged = _mode(post, rows, ranges[response][0], positive)
    cov = inverse(_definite(hess) + post.selector.penalty(rho) + np.diag(post.precision))
    draws, log_sp, accepted = sample(post, beta, cov, rho, nsamples, nchains, warmup, seed, control)
    fit = MultiParameterModel(fam, stacked, full, post.coefficients(beta), rho, cov, np.zeros(stacked.p), float(nll), float("nan"), n, passes, converged, narrow, rows)
    return BayesModel(fit, positive, draws, log_sp, priors, accepted, post.passes, post.names)


def _mode(post: Posterior, rows, lo: float, positive: np.ndarray):
    """Coefficients, smoothing parameters and curvature to begin with: the penalised fit, or without smoothing
    selection Newton steps where coefficients are constrained."""
    stacked, fam, response = post.stacked, post.family, post.response
    m = rows.sweep(lambda cols: {"m": np.array([(cols[WEIGHT] * cols[response]).sum(), (cols[WEIGHT] * cols[response] ** 2).sum(), cols[WEIGHT].sum()])})["m"]
    mean = m[0] / m[2]
    beta = np.zeros(stacked.p)
    for k, e in enumerate(fam.start(mean, float(np.sqrt(max(m[1] / m[2] - mean**2, 1e-12))), lo)):
        if stacked.designs[k].formula.intercept:
            beta[stacked.starts[k]] = e
    if not positive.any():
        return fit_stacked(stacked, rows, fam, response, beta, GamlssControl())[:6]
    raw = np.where(positive, -2.0, beta)
    rho, value, passes = np.zeros(len(post.selector.units)), np.inf, 0

    def sweep(raw):
        b = post.coefficients(raw)
        r = rows.sweep(likelihood_pass(stacked, fam, response, b))
        d = np.where(positive, b, 1.0)
        return float(r["s"][0]), r["grad"] * d, r["hess"] * d[:, None] * d + np.diag(np.where(positive, r["grad"] * b, 0.0))

    for _ in range(60):
        nll, grad, hess = sweep(raw)
        passes += 1
        h = _definite(hess)
        rho = post.selector.start(h) if passes == 1 else rho
        pen = post.selector.penalty(rho) + np.diag(post.precision)
        slope = grad + pen @ raw - post.precision * post.mean
        step, value = inverse(h + pen) @ slope, nll + 0.5 * raw @ pen @ raw - raw @ (post.precision * post.mean)
        size = min(1.0, 3.0 / max(np.abs(step[positive]).max(), 1e-300))
        for _ in range(20):
            new = raw - size * step
            then = sweep(new)[0] + 0.5 * new @ pen @ new - new @ (post.precision * post.mean)
            passes += 1
            if np.isfinite(then) and then <= value:
                break
            size /= 2
        raw = new
        if abs(value - then) < 1e-7 * (1 + abs(value)):
            break
    nll, _, hess = sweep(raw)
    return raw, rho, hess, nll, passes, True
