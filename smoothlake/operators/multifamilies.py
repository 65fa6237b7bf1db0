"""Families with several linear predictors: location-scale-shape and extreme values.

A family says its negative log-likelihood in the parameters, once, for arrays and for second-order jets; with the
predictors as jets its derivatives are exact.
"""

from __future__ import annotations

import math

import numpy as np

from smoothlake.functions.jets import Jet, apply_link, exp, expm1, log, log1p, log1p_ratio, log_gamma, logistic, softplus, value, where
from smoothlake.functions.special import expit, log1pexp, normal_ppf
from smoothlake.operators.families import link

BAD = 1e10  # a row outside the support


class MultiFamily:
    """names and links of the parameters; ``nll(y, *parameters)`` per row; ``start(y stats)`` of the predictors."""

    names: tuple[str, ...] = ()
    links: tuple[str, ...] = ()
    positive_response = False
    quadratic = False  # the likelihood, in the response

    def __init__(self, links: tuple[str, ...] | None = None):
        self.links = tuple(links) if links else type(self).links
        if len(self.links) != len(self.names):
            raise ValueError(f"{type(self).__name__} has the parameters {self.names}")

    def nparams(self) -> int:
        return len(self.names)

    def param_names(self) -> tuple[str, ...]:
        return self.names

    def inverse(self, etas) -> list[np.ndarray]:
        return [link(n).inv(e) for n, e in zip(self.links, etas, strict=True)]

    def nll(self, y, *parameters) -> np.ndarray:
        raise NotImplementedError

    def nll_eta(self, y, etas) -> np.ndarray:
        with np.errstate(all="ignore"):
            v = self.nll(y, *self.inverse(etas))
        return np.where(np.isfinite(v), v, BAD)

    def start(self, mean: float, sd: float, lo: float) -> list[float]:
        raise NotImplementedError

    def valid(self, lo: float, hi: float) -> str | None:
        return f"{type(self).__name__} needs positive responses" if self.positive_response and lo <= 0 else None

    def derivatives(self, y, etas) -> tuple[np.ndarray, list[np.ndarray], list[list[np.ndarray]]]:
        """(nll, gradient by predictor, second derivatives by pair)."""
        with np.errstate(all="ignore"):
            jets = [apply_link(link(n), e) for n, e in zip(self.links, Jet.variables(etas), strict=True)]
            f, grad, hess = self.nll(np.asarray(y, float), *jets).parts()
        ok = np.isfinite(f)
        for v in (*grad, *(x for row in hess for x in row)):
            ok &= np.isfinite(v)
        return np.where(ok, f, BAD), [np.where(ok, v, 0.0) for v in grad], [[np.where(ok, v, 0.0) for v in row] for row in hess]


class GaussianLS(MultiFamily):
    names, links = ("mu", "sigma"), ("identity", "log")
    quadratic = True

    def nll(self, y, mu, sigma):
        return 0.5 * ((y - mu) / sigma) ** 2 + log(sigma) + 0.5 * math.log(2 * math.pi)

    def start(self, mean, sd, lo):
        return [mean, math.log(max(sd, 1e-8))]

    def derivatives(self, y, etas):
        if self.links != ("identity", "log"):
            return super().derivatives(y, etas)
        mu, s2 = etas[0], np.exp(-2 * np.clip(etas[1], -300, 300))
        r = y - mu
        f = 0.5 * r * r * s2 + etas[1] + 0.5 * math.log(2 * math.pi)
        cross = 2 * r * s2
        return f, [-r * s2, 1 - r * r * s2], [[s2, cross], [cross, 2 * r * r * s2]]


class GammaLS(MultiFamily):
    """Mean and coefficient of variation."""

    names, links, positive_response = ("mu", "sigma"), ("log", "log"), True

    def nll(self, y, mu, sigma):
        a = 1 / sigma**2
        return log_gamma(a) - a * log(a) + a * log(mu) - (a - 1) * np.log(y) + a * y / mu

    def start(self, mean, sd, lo):
        return [math.log(mean), math.log(max(sd / mean, 1e-4))]


class BetaLS(MultiFamily):
    names, links = ("mu", "phi"), ("logit", "log")

    def nll(self, y, mu, phi):
        a, b = mu * phi, (1 - mu) * phi
        return log_gamma(a) + log_gamma(b) - log_gamma(phi) - (a - 1) * np.log(y) - (b - 1) * np.log1p(-y)

    def start(self, mean, sd, lo):
        phi = max(mean * (1 - mean) / max(sd, 1e-6) ** 2 - 1, 0.1)
        return [math.log(mean / (1 - mean)), math.log(phi)]

    def valid(self, lo, hi):
        return "beta responses lie in (0, 1)" if lo <= 0 or hi >= 1 else None


class NegBinLS(MultiFamily):
    """Mean and sigma with r = 1 / sigma^2."""

    names, links = ("mu", "sigma"), ("log", "log")

    def nll(self, y, mu, sigma):
        r = 1 / sigma**2
        return log_gamma(r) + log_gamma(y + 1) - log_gamma(y + r) - r * log(r / (r + mu)) - y * log(mu / (r + mu))

    def start(self, mean, sd, lo):
        return [math.log(max(mean, 1e-3)), 0.5 * math.log(max((sd**2 - mean) / max(mean, 1e-3) ** 2, 0.05))]


class InverseGaussianLS(MultiFamily):
    """Mean and sigma with lambda = mu / sigma^2."""

    names, links, positive_response = ("mu", "sigma"), ("log", "log"), True

    def nll(self, y, mu, sigma):
        lam = mu / sigma**2
        return 0.5 * (math.log(2 * math.pi) + 3 * np.log(y) - log(lam)) + lam * (y - mu) ** 2 / (2 * mu * mu * y)

    def start(self, mean, sd, lo):
        return [math.log(mean), math.log(max(sd / mean, 1e-3))]


class GEV(MultiFamily):
    """Location, log scale, shape of block maxima."""

    names, links = ("mu", "psi", "xi"), ("identity", "identity", "identity")

    def nll(self, y, mu, psi, xi):
        z = (y - mu) * exp(-psi)
        t = z * log1p_ratio(xi * z)  # log(1 + xi z) / xi; not a number outside the support
        return psi + (xi + 1) * t + exp(-t)

    def start(self, mean, sd, lo):
        s = sd * math.sqrt(6) / math.pi
        return [mean - 0.5772 * s, math.log(max(s, 1e-8)), 0.1]


def _gpd(y, psi, xi):
    """(nll, log survival) of the generalised Pareto distribution; not numbers outside its support."""
    z = np.where(y >= 0, y, np.nan) * exp(-psi)
    t = z * log1p_ratio(xi * z)
    return psi + (xi + 1) * t, -t


class GPD(MultiFamily):
    """Log scale and shape of excesses over a threshold."""

    names, links = ("psi", "xi"), ("identity", "identity")

    def __init__(self, threshold: float = 0.0, links=None):
        super().__init__(links)
        self.threshold = threshold

    def nll(self, y, psi, xi):
        return _gpd(y - self.threshold, psi, xi)[0]

    def start(self, mean, sd, lo):
        return [math.log(max(mean - self.threshold, 1e-8)), 0.1]

    def valid(self, lo, hi):
        return "a response lies under the threshold" if lo < self.threshold else None


class EGPD1(MultiFamily):
    """Power extension: distribution F^kappa of the generalised Pareto F."""

    names, links, positive_response = ("psi", "xi", "lkappa"), ("identity",) * 3, True

    def nll(self, y, psi, xi, lk):
        n, s = _gpd(y, psi, xi)
        return n + (1 - exp(lk)) * log(-expm1(s)) - lk

    def start(self, mean, sd, lo):
        return [math.log(mean), 0.1, 0.0]


class EGPD2(MultiFamily):
    """Mixture of two powers, p F^k1 + (1 - p) F^k2 with k2 > k1."""

    names, links, positive_response = ("psi", "xi", "lkappa1", "ldkappa", "logitp"), ("identity",) * 5, True

    def nll(self, y, psi, xi, lk, ld, lp):
        n, s = _gpd(y, psi, xi)
        logf = log(-expm1(s))
        k1 = exp(lk)
        k2 = k1 + exp(ld)
        p = logistic(lp)
        return n - log(p * k1 * exp((k1 - 1) * logf) + (1 - p) * k2 * exp((k2 - 1) * logf))

    def start(self, mean, sd, lo):
        return [math.log(mean), 0.05, 0.0, 0.0, 0.0]


class EGPD3(MultiFamily):
    """Beta-type extension: density of the generalised Pareto times (1 + delta) / delta (1 - S^delta)."""

    names, links, positive_response = ("psi", "xi", "ldelta"), ("identity",) * 3, True

    def nll(self, y, psi, xi, ld):
        n, s = _gpd(y, psi, xi)
        d = exp(ld)
        return n + ld - log(-expm1(d * s)) - log1p(d)

    def start(self, mean, sd, lo):
        return [math.log(mean), 0.1, 0.0]


class EGPD4(MultiFamily):
    """The third extension to the power kappa / 2."""

    names, links, positive_response = ("psi", "xi", "ldelta", "lkappa"), ("identity",) * 4, True

    def nll(self, y, psi, xi, ld, lk):
        n, s = _gpd(y, psi, xi)
        d, k = exp(ld), exp(lk)
        # distribution of the third extension, from the survival S of the generalised Pareto
        g3 = exp(s) * expm1(d * s) / d - expm1(s)
        return (1 - k / 2) * log(g3) + n + math.log(2) + ld - lk - log(-expm1(d * s)) - log1p(d)

    def start(self, mean, sd, lo):
        return [math.log(mean), 0.1, 0.0, math.log(2)]


class ELF(MultiFamily):
    """Smoothed pinball loss of quantile ``qu``; bandwidth ``co`` and learning rate exp(lsig)."""

    names, links = ("mu",), ("identity",)

    def __init__(self, qu: float, co: float, lsig: float = 0.0):
        super().__init__()
        if not 0 < qu < 1:
            raise ValueError("a quantile lies in (0, 1)")
        self.qu, self.co, self.lsig = qu, co, lsig

    def nll(self, y, mu):
        return self.loss(y - mu, np.exp(self.lsig))

    def loss(self, z, sigma):
        t, c = self.qu, self.co
        return ((1 - t) * c * math.log(1 - t) + t * c * math.log(t) - (1 - t) * z + c * log1pexp(z / c)) / sigma

    def derivatives(self, y, etas):
        z, s = y - etas[0], math.exp(self.lsig)
        f = expit(z / self.co)
        return self.loss(z, s), [((1 - self.qu) - f) / s], [[f * (1 - f) / (self.co * s)]]

    def start(self, mean, sd, lo):
        return [mean + sd * float(normal_ppf(self.qu))]


class ELFLSS(MultiFamily):
    """Quantile and a learning rate of its own; the log-density of the smoothed pinball loss."""

    names, links = ("mu", "sigma"), ("identity", "log")

    def __init__(self, qu: float, co: float, links=None):
        super().__init__(links)
        self.qu, self.co = qu, co

    def nll(self, y, mu, sigma):
        t, z = self.qu, y - mu
        lam = self.co / sigma  # the bandwidth relative to the scale
        lam = where(value(lam) > 1e-3, lam, 1e-3)
        norm = log_gamma(lam * (1 - t)) + log_gamma(lam * t) - log_gamma(lam) + log(lam * sigma)
        return -(1 - t) * z / sigma + lam * softplus(z / (lam * sigma)) + norm

    def start(self, mean, sd, lo):
        return [mean + sd * float(normal_ppf(self.qu)), math.log(max(sd / 2, 1e-6))]


DISTRIBUTIONS = {"normal": GaussianLS, "gamma": GammaLS, "beta": BetaLS, "negative_binomial": NegBinLS, "inverse_gaussian": InverseGaussianLS, "gev": GEV, "gpd": GPD, "egpd1": EGPD1, "egpd2": EGPD2, "egpd3": EGPD3, "egpd4": EGPD4}
