"""Response distributions and links: variance, deviance, saturated likelihood, starting means, validity."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from smoothlake.functions.special import digamma, expit, lgamma, normal_cdf, normal_pdf, normal_ppf, trigamma


class Link:
    """g, its inverse and the inverse's first three derivatives."""

    def __init__(self, name, g, inv, d1, d2):
        self.name, self.g, self.inv, self.d1, self.d2, self.d3 = name, g, inv, d1, d2, THIRD[name]

    def __reduce__(self):
        return (link, (self.name,))


def _cloglog_d(e):
    return np.exp(np.clip(e, -700, 30) - np.exp(np.clip(e, -700, 30)))


LINKS = {
    "identity": (lambda m: m, lambda e: e, np.ones_like, np.zeros_like),
    "log": (np.log, lambda e: np.exp(np.clip(e, -300, 300)), lambda e: np.exp(np.clip(e, -300, 300)), lambda e: np.exp(np.clip(e, -300, 300))),
    "logit": (lambda m: np.log(m / (1 - m)), expit, lambda e: expit(e) * expit(-e), lambda e: expit(e) * expit(-e) * (1 - 2 * expit(e))),
    "inverse": (lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / e**2, lambda e: 2 / e**3),
    "inverse_squared": (lambda m: 1 / m**2, lambda e: 1 / np.sqrt(e), lambda e: -0.5 * e**-1.5, lambda e: 0.75 * e**-2.5),
    "sqrt": (np.sqrt, lambda e: e**2, lambda e: 2 * e, lambda e: np.full_like(e, 2.0)),
    "probit": (normal_ppf, normal_cdf, normal_pdf, lambda e: -e * normal_pdf(e)),
    "cauchit": (lambda m: np.tan(math.pi * (m - 0.5)), lambda e: 0.5 + np.arctan(e) / math.pi, lambda e: 1 / (math.pi * (1 + e * e)), lambda e: -2 * e / (math.pi * (1 + e * e) ** 2)),
    "cloglog": (lambda m: np.log(-np.log1p(-m)), lambda e: -np.expm1(-np.exp(np.clip(e, -700, 30))), _cloglog_d, lambda e: _cloglog_d(e) * (1 - np.exp(np.clip(e, -700, 30)))),
}

#: Third derivatives of the inverses.
THIRD = {
    "identity": np.zeros_like,
    "log": LINKS["log"][1],
    "logit": lambda e: expit(e) * expit(-e) * (1 - 6 * expit(e) * expit(-e)),
    "inverse": lambda e: -6 / e**4,
    "inverse_squared": lambda e: -1.875 * e**-3.5,
    "sqrt": np.zeros_like,
    "probit": lambda e: (e * e - 1) * normal_pdf(e),
    "cauchit": lambda e: (6 * e * e - 2) / (math.pi * (1 + e * e) ** 3),
    "cloglog": lambda e: _cloglog_d(e) * ((1 - np.exp(np.clip(e, -700, 30))) ** 2 - np.exp(np.clip(e, -700, 30))),
}


def link(name: str) -> Link:
    if name not in LINKS:
        raise ValueError(f"unknown link {name!r}; known are {', '.join(LINKS)}")
    return Link(name, *LINKS[name])


def xlogy(x, y):
    return np.where(x > 0, x * np.log(np.where(x > 0, y, 1.0)), 0.0)


@dataclass
class Family:
    """One mean parameter. link_name: of the mean. known_scale: the dispersion is one."""

    link_name: str = ""
    name = "normal"
    default_link = "identity"
    known_scale = False
    exponential = True  # unit deviances with per-group sufficient statistics: rows may be compressed
    links = ("identity", "log", "inverse")

    def __post_init__(self):
        self.link_name = self.link_name or self.default_link
        if self.link_name not in self.links:
            raise ValueError(f"{self.name} takes the links {', '.join(self.links)}, not {self.link_name}")

    @property
    def link(self) -> Link:
        return link(self.link_name)

    def valid(self, lo: float, hi: float) -> str | None:
        return None

    def start(self, y, w):
        return y.astype(float)

    def clip(self, mu):
        return mu

    def variance(self, mu):
        return np.ones_like(mu)

    def variance_d(self, mu):
        return np.zeros_like(mu)

    def variance_d2(self, mu):
        return np.zeros_like(mu)

    def deviance(self, y, mu, w):
        return w * (y - mu) ** 2

    def saturated(self, y):
        """s(y) with unit deviance 2 (s(y) - ...): what compressed rows lack within a group."""
        return 0.5 * y * y

    def loglik(self, y, mu, w, scale):
        return -0.5 * (w * (y - mu) ** 2 / scale + np.log(2 * math.pi * scale / w))

    def simulate(self, mu, w, scale, rng):
        return rng.normal(mu, np.sqrt(scale / w))

    def extra(self) -> dict:
        return {}


@dataclass
class Normal(Family):
    links = ("identity", "log", "inverse", "sqrt")


@dataclass
class Poisson(Family):
    name, default_link, known_scale = "poisson", "log", True
    links = ("log", "identity", "sqrt")

    def valid(self, lo, hi):
        return "Poisson responses are not negative" if lo < 0 else None

    def start(self, y, w):
        return y + 0.1

    def clip(self, mu):
        return np.maximum(mu, 1e-10)

    def variance(self, mu):
        return mu

    def variance_d(self, mu):
        return np.ones_like(mu)

    def deviance(self, y, mu, w):
        return 2 * w * (xlogy(y, y / mu) - (y - mu))

    def saturated(self, y):
        return xlogy(y, y) - y

    def loglik(self, y, mu, w, scale):
        return w * (xlogy(y, mu) - mu - lgamma(y + 1))

    def simulate(self, mu, w, scale, rng):
        return rng.poisson(mu).astype(float)

    def pmf(self, k, mu):
        return np.exp(xlogy(np.full_like(mu, k), mu) - mu - math.lgamma(k + 1))


@dataclass
class QuasiPoisson(Poisson):
    name, known_scale = "quasipoisson", False


@dataclass
class Binomial(Family):
    """Shares of successes; weights are the numbers of trials."""

    name, default_link, known_scale = "binomial", "logit", True
    links = ("logit", "probit", "cauchit", "cloglog", "log", "identity")

    def valid(self, lo, hi):
        return "binomial responses lie in [0, 1]" if lo < 0 or hi > 1 else None

    def start(self, y, w):
        return (w * y + 0.5) / (w + 1)

    def clip(self, mu):
        return np.clip(mu, 1e-10, 1 - 1e-10)

    def variance(self, mu):
        return mu * (1 - mu)

    def variance_d(self, mu):
        return 1 - 2 * mu

    def variance_d2(self, mu):
        return np.full_like(mu, -2.0)

    def deviance(self, y, mu, w):
        return 2 * w * (xlogy(y, y / mu) + xlogy(1 - y, (1 - y) / (1 - mu)))

    def saturated(self, y):
        return xlogy(y, y) + xlogy(1 - y, 1 - y)

    def loglik(self, y, mu, w, scale):
        k = w * y
        return lgamma(w + 1) - lgamma(k + 1) - lgamma(w - k + 1) + xlogy(k, mu) + xlogy(w - k, 1 - mu)

    def simulate(self, mu, w, scale, rng):
        n = np.maximum(np.round(w), 1).astype(int)
        return rng.binomial(n, mu) / n


@dataclass
class QuasiBinomial(Binomial):
    name, known_scale = "quasibinomial", False


@dataclass
class Gamma(Family):
    name, default_link = "gamma", "inverse"
    links = ("inverse", "log", "identity")

    def valid(self, lo, hi):
        return "Gamma responses are positive" if lo <= 0 else None

    def clip(self, mu):
        return np.maximum(mu, 1e-10)

    def variance(self, mu):
        return mu * mu

    def variance_d(self, mu):
        return 2 * mu

    def variance_d2(self, mu):
        return np.full_like(mu, 2.0)

    def deviance(self, y, mu, w):
        return 2 * w * ((y - mu) / mu - np.log(y / mu))

    def saturated(self, y):
        return -np.log(y) - 1

    def loglik(self, y, mu, w, scale):
        a = w / scale
        return a * np.log(a * y / mu) - a * y / mu - np.log(y) - lgamma(a)

    def simulate(self, mu, w, scale, rng):
        return rng.gamma(w / scale, mu * scale / w)


@dataclass
class InverseGaussian(Gamma):
    name, default_link = "inverse_gaussian", "inverse_squared"
    links = ("inverse_squared", "inverse", "log", "identity")

    def variance(self, mu):
        return mu**3

    def variance_d(self, mu):
        return 3 * mu * mu

    def variance_d2(self, mu):
        return 6 * mu

    def deviance(self, y, mu, w):
        return w * (y - mu) ** 2 / (mu * mu * y)

    def saturated(self, y):
        return 0.5 / y

    def loglik(self, y, mu, w, scale):
        return -0.5 * (np.log(2 * math.pi * scale * y**3 / w) + w * (y - mu) ** 2 / (scale * mu * mu * y))

    def simulate(self, mu, w, scale, rng):
        return rng.wald(mu, w / scale)


@dataclass
class NegativeBinomial(Poisson):
    """V = mu + mu^2 / theta; theta is estimated unless ``estimate`` is false."""

    theta: float = 1.0
    estimate: bool = True
    name, exponential = "negative_binomial", False

    def variance(self, mu):
        return mu + mu * mu / self.theta

    def variance_d(self, mu):
        return 1 + 2 * mu / self.theta

    def deviance(self, y, mu, w):
        t = self.theta
        return 2 * w * (xlogy(y, y / mu) - (y + t) * np.log((y + t) / (mu + t)))

    def loglik(self, y, mu, w, scale):
        t = self.theta
        return w * (lgamma(y + t) - lgamma(np.full_like(y, t)) - lgamma(y + 1) + t * np.log(t / (mu + t)) + xlogy(y, mu / (mu + t)))

    def theta_derivatives(self, y, mu, w):
        """Of the log-likelihood in log theta."""
        t = self.theta
        d = w * (digamma(y + t) - digamma(np.full_like(y, t)) + np.log(t / (mu + t)) + 1 - (y + t) / (mu + t))
        d2 = w * (trigamma(y + t) - trigamma(np.full_like(y, t)) + 1 / t - 2 / (mu + t) + (y + t) / (mu + t) ** 2)
        return t * d, t * d + t * t * d2

    def simulate(self, mu, w, scale, rng):
        return rng.poisson(rng.gamma(self.theta, mu / self.theta)).astype(float)

    def pmf(self, k, mu):
        return np.exp(self.loglik(np.full_like(mu, k), mu, np.ones_like(mu), 1.0))

    def extra(self):
        return {"theta": self.theta}


@dataclass
class Tweedie(Poisson):
    """V = mu^p, 1 < p < 2; p is chosen by profile likelihood if ``estimate``."""

    p: float = 1.5
    estimate: bool = False
    name, known_scale, exponential = "tweedie", False, False
    links = ("log", "identity", "sqrt")

    def __post_init__(self):
        super().__post_init__()
        if not 1 < self.p < 2:
            raise ValueError("Tweedie needs 1 < p < 2")

    def variance(self, mu):
        return mu**self.p

    def variance_d(self, mu):
        return self.p * mu ** (self.p - 1)

    def deviance(self, y, mu, w):
        p = self.p
        return 2 * w * (y ** (2 - p) / ((1 - p) * (2 - p)) - y * mu ** (1 - p) / (1 - p) + mu ** (2 - p) / (2 - p))

    def loglik(self, y, mu, w, scale, p=None):
        """The series of the density, summed around its largest term."""
        p = self.p if p is None else p
        phi = scale / w
        out = -(mu ** (2 - p)) / (phi * (2 - p))
        pos = np.flatnonzero(y > 0)
        if len(pos):
            yy, ph, m = y[pos], np.broadcast_to(phi, y.shape)[pos], mu[pos]
            a = (2 - p) / (p - 1)
            top = np.maximum(1, np.round(yy ** (2 - p) / (ph * (2 - p))))
            base = a * np.log(yy) - (1 + a) * np.log(ph) - a * math.log(p - 1) - math.log(2 - p)
            # terms fall off like a normal density whose variance is below the largest one's index
            half = int(12 + 8 * math.sqrt(float(top.max())))
            if half > 2000:  # in runs of rows, so that the table of terms stays small
                step = max(1, 4_000_000 // half)
                if len(y) > step:
                    return np.concatenate([self.loglik(y[i : i + step], mu[i : i + step], np.broadcast_to(w, y.shape)[i : i + step], scale, p) for i in range(0, len(y), step)])
            j = np.maximum(top[:, None] + np.arange(-half, half + 1), 0.0)
            real = (top[:, None] + np.arange(-half, half + 1)) >= 1
            j = np.maximum(j, 1.0)
            t = np.where(real, j * base[:, None] - lgamma(j + 1) - lgamma(a * j), -np.inf)
            biggest = t.max(axis=1)
            series = biggest + np.log(np.exp(t - biggest[:, None]).sum(axis=1))
            out[pos] = series - np.log(yy) + (yy * m ** (1 - p) / (1 - p) - m ** (2 - p) / (2 - p)) / ph
        return out

    def simulate(self, mu, w, scale, rng):
        p = self.p
        phi = scale / w
        n = rng.poisson(mu ** (2 - p) / (phi * (2 - p)))
        return np.where(n > 0, rng.gamma(np.maximum(n, 1) * (2 - p) / (p - 1), phi * (p - 1) * mu ** (p - 1)), 0.0)

    def extra(self):
        return {"p": self.p}


@dataclass
class Beta(Family):
    """Shares in (0, 1) with V = mu (1 - mu) / (1 + phi)."""

    phi: float = 1.0
    estimate: bool = True
    name, default_link, known_scale, exponential = "beta", "logit", True, False
    links = ("logit", "probit", "cauchit", "cloglog")

    def valid(self, lo, hi):
        return "beta responses lie in (0, 1)" if lo <= 0 or hi >= 1 else None

    def start(self, y, w):
        return np.clip(y, 0.01, 0.99)

    def clip(self, mu):
        return np.clip(mu, 1e-8, 1 - 1e-8)

    def variance(self, mu):
        return mu * (1 - mu) / (1 + self.phi)

    def variance_d(self, mu):
        return (1 - 2 * mu) / (1 + self.phi)

    def working(self, y, mu, w):
        """Score and expected information in the mean."""
        p = self.phi
        a, b = mu * p, (1 - mu) * p
        return w * p * (np.log(y / (1 - y)) - digamma(a) + digamma(b)), w * p * p * (trigamma(a) + trigamma(b))

    def deviance(self, y, mu, w):
        return 2 * (self.loglik(y, self.clip(y), w, 1.0) - self.loglik(y, mu, w, 1.0))

    def loglik(self, y, mu, w, scale):
        p = self.phi
        a, b = mu * p, (1 - mu) * p
        return w * (lgamma(np.full_like(mu, p)) - lgamma(a) - lgamma(b) + (a - 1) * np.log(y) + (b - 1) * np.log1p(-y))

    def theta_derivatives(self, y, mu, w):
        p = self.phi
        a, b = mu * p, (1 - mu) * p
        d = w * (digamma(np.full_like(mu, p)) - mu * digamma(a) - (1 - mu) * digamma(b) + mu * np.log(y) + (1 - mu) * np.log1p(-y))
        d2 = w * (trigamma(np.full_like(mu, p)) - mu**2 * trigamma(a) - (1 - mu) ** 2 * trigamma(b))
        return p * d, p * d + p * p * d2

    def simulate(self, mu, w, scale, rng):
        return rng.beta(mu * self.phi, (1 - mu) * self.phi)

    def extra(self):
        return {"phi": self.phi}


FAMILIES = {c.name: c for c in (Normal, Poisson, QuasiPoisson, Binomial, QuasiBinomial, Gamma, InverseGaussian, NegativeBinomial, Tweedie, Beta)}
FAMILIES |= {"gaussian": Normal, "bernoulli": Binomial, "nb": NegativeBinomial, "tw": Tweedie, "betar": Beta}


def family_of(f: str | Family | None, link_name: str | None = None) -> Family:
    if f is None:
        f = "normal"
    if isinstance(f, str):
        if f.lower() not in FAMILIES:
            raise ValueError(f"unknown family {f!r}; known are {', '.join(FAMILIES)}")
        return FAMILIES[f.lower()](link_name or "")
    return f
