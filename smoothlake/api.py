"""The public names in one place, with the aliases under which models of this kind are commonly known."""

from __future__ import annotations

import numpy as np

from smoothlake.functions.special import log1pexp, softplus
from smoothlake.operators.bases import (
    Basis, BSpline, ConstrainedSpline, Cubic, FactorSmooth, FractionalPolynomial, GaussianProcess, Loess, OneHot, ShapeSpline, SoapFilm, Spde, Sphere, Tensor, ThinPlate, make,
)
from smoothlake.operators.bayes import BayesGamModel, PriorSpec, default_priors, get_prior, ginla, is_loo, loo, pareto_k_diagnostic, pointwise_loglikelihood, psis_loo, waic
from smoothlake.operators.bayes_hmc import BayesModel, HmcControl, bayes
from smoothlake.operators.diagnostics import (
    anova_gam, appraise, concurvity, data_slice, derivatives, fitted_samples, gam_check, gamcontour, gamplot, k_check, overview, partial_residuals, posterior_samples, predicted_samples, rootogram, smooth_estimates, smooth_samples, vis_gam,
)
from smoothlake.operators.families import Beta, Binomial, Family, Gamma, InverseGaussian, NegativeBinomial, Normal, Poisson, QuasiBinomial, QuasiPoisson, Tweedie
from smoothlake.operators.gam import BamControl, GamControl, bam, bam_control, gam, gam_control
from smoothlake.operators.gamlss import GamlssControl, MultiParameterModel, evgam, evgam_control, gamlss, gamlss_control, mp_laml
from smoothlake.operators.gamm import GammModel, gamm
from smoothlake.operators.gamm_crossed import CrossedControl, CrossedGammModel, gamm_crossed
from smoothlake.operators.gamm_large import LargeGammModel, gamm_large
from smoothlake.operators.general import fit_general
from smoothlake.operators.knots import discretize_covariates, knot_quantiles, laplacian, place_knots
from smoothlake.operators.mixed import SmoothMixed, gam_matrices, gam_smooth, s2r_predict, smooth2random
from smoothlake.operators.model import GamModel, load
from smoothlake.operators.multifamilies import EGPD1, EGPD2, EGPD3, EGPD4, ELF, ELFLSS, GEV, GPD, BetaLS, GammaLS, GaussianLS, InverseGaussianLS, MultiFamily, NegBinLS
from smoothlake.operators.qgam import QgamModel, check_qgam, cqcheck, mqgam, pinball_loss, qdo, qgam, quantile_residuals
from smoothlake.operators.scam import ScamControl, has_shape_constraints, scam, scam_control, scasm
from smoothlake.plans.formula import Formula, RandomSpec, SmoothSpec, parse, s, t2, te, ti
from smoothlake.streaming.accumulate import StreamingGam

fit = gam
re = RandomSpec
NegBinFamily, QuasiPoissonFamily, QuasiBinomialFamily, TweedieFamily, BetaFamily, ELFFamily, ELFLSSFamily = NegativeBinomial, QuasiPoisson, QuasiBinomial, Tweedie, Beta, ELF, ELFLSS
GEVFamily, GPDFamily, EGPD1Family, EGPD2Family, EGPD3Family, EGPD4Family = GEV, GPD, EGPD1, EGPD2, EGPD3, EGPD4
GammaLocationScale, BetaRegression, NegativeBinomialLocationScale, InverseGaussianLocationScale = GammaLS, BetaLS, NegBinLS, InverseGaussianLS
smooth_construct = make


def cr(*columns: str, **more) -> SmoothSpec:
    """A cubic regression spline; ``tp``, ``ts``, ``cs``, ``cc``, ``ps`` and ``cps`` likewise."""
    return s(*columns, **{"bs": "cr", **more})


def tp(*columns: str, **more) -> SmoothSpec:
    return s(*columns, **{"bs": "tp", **more})


def ts(*columns: str, **more) -> SmoothSpec:
    return s(*columns, **{"bs": "ts", **more})


def cs(*columns: str, **more) -> SmoothSpec:
    return s(*columns, **{"bs": "cs", **more})


def cc(*columns: str, **more) -> SmoothSpec:
    return s(*columns, **{"bs": "cc", **more})


def ps(*columns: str, **more) -> SmoothSpec:
    return s(*columns, **{"bs": "ps", **more})


def cps(*columns: str, **more) -> SmoothSpec:
    return s(*columns, **{"bs": "cps", **more})


def predict_matrix(basis: Basis, columns: dict[str, np.ndarray]) -> np.ndarray:
    """The raw columns of a basis for a block of rows."""
    return basis.raw(columns)


def penalty_matrix(basis: Basis) -> list[np.ndarray]:
    return basis.penalties


def null_space_dim(basis: Basis) -> int:
    return basis.null_dim


def nll_obs(family: MultiFamily, y, etas) -> np.ndarray:
    """The negative log-likelihood of each row."""
    return family.nll_eta(np.asarray(y, float), etas)


def nll_total(family: MultiFamily, y, etas) -> float:
    return float(nll_obs(family, y, etas).sum())


def nll_derivs(family: MultiFamily, y, etas):
    return family.derivatives(np.asarray(y, float), etas)


def model_edf(m) -> float:
    return m.model_edf()


edf = model_edf

__all__ = sorted(n for n in dir() if not n.startswith("_") and n not in ("annotations", "np"))
