"""Hamiltonian draws against fits, truths and stored posterior draws."""

import os

import numpy as np
import pandas as pd
import pytest

from smoothlake.operators.bayes import PriorSpec
from smoothlake.operators.bayes_hmc import bayes
from smoothlake.operators.gam import GamControl, gam
from smoothlake.operators.gamlss import gamlss
from smoothlake.operators.multifamilies import GPD, GaussianLS
from smoothlake.sources.rows import LocalRows, SparkRows

FEW = dict(nsamples=300, nchains=4, warmup=150)


def test_several_parameters_are_drawn_around_their_fit(spark):
    rng = np.random.default_rng(31)
    x = rng.random(400)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": rng.normal(1 + 2 * x, np.exp(-1 + x))}))
    fit = gamlss(["y ~ x", "~ x"], df, GaussianLS())
    m = bayes(["y ~ x", "~ x"], df, GaussianLS(), **FEW)
    assert m.rhat().max() < 1.05 and m.accepted > 0.5
    assert np.abs(m.coef() - fit.beta).max() < 0.05
    assert np.allclose(m.coefficients.std(axis=0), fit.stderror(), rtol=0.2)
    assert [r.term for r in m.coeftable().collect()] == ["mu:(Intercept)", "mu:x", "sigma:(Intercept)", "sigma:x"]
    far = bayes(["y ~ x", "~ x"], df, GaussianLS(), nsamples=2, nchains=2, warmup=2, gam_control=GamControl(local_rows=0))
    assert far.passes < 40 and np.isfinite(far.draws).all()  # a pass per step, not per chain


def test_stored_poisson_posterior(spark):
    """Mean and deviation of the stored draws of the intercept."""
    df = spark.createDataFrame(pd.read_csv(os.path.join(os.path.dirname(__file__), "golden", "bayes_poisson.csv"))[["x", "y"]])
    m = bayes("y ~ s(x, k=10)", df, "poisson", **FEW)
    assert m.rhat().max() < 1.05
    draws = m.coefficients[:, 0]
    assert abs(draws.mean() - 0.908322) < 0.03 and abs(draws.std() - 0.053471) < 0.012
    assert m.log_sp.std() > 0.1  # smoothing moves
    p = m.predict(df.limit(5)).toPandas()
    assert (p.lower < p.fit).all() and (p.fit < p.upper).all()


def test_dispersion_random_effects_and_shapes(spark):
    rng = np.random.default_rng(33)
    g, x = rng.integers(0, 12, 360), rng.random(360)
    u = rng.normal(0, 0.8, 12)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": [f"g{i:02d}" for i in g], "y": 1 + x + u[g] + rng.normal(0, 0.5, 360), "z": np.sqrt(x) * 3 + rng.normal(0, 0.3, 360)}))
    m = bayes("y ~ x + (1 | g)", df, **FEW)
    sd = np.exp(-m.log_sp / 2).mean()
    assert m.rhat().max() < 1.1 and m.names[-1] == "sigma:(Intercept)" and abs(np.exp(m.coef()[-1]) - 0.5) < 0.06
    effects = m.coef()[2:14]
    assert np.corrcoef(effects, u)[0, 1] > 0.97 and sd > 0
    shape = bayes("z ~ s(x, k=6, bs='mpi')", df, nsamples=200, nchains=4, warmup=200)
    assert shape.positive.any() and (shape.coefficients[:, shape.positive] > 0).all() and abs(np.exp(shape.coef()[-1]) - 0.3) < 0.05
    curve = shape.predict(df).toPandas().sort_values("x").fit.to_numpy()
    assert (np.diff(curve) > -1e-9).all() and np.abs(curve - 3 * np.sqrt(np.sort(x)))[30:-30].max() < 0.25


def test_priors_hold_and_arguments_are_checked(spark):
    rng = np.random.default_rng(34)
    df = spark.createDataFrame(pd.DataFrame({"y": rng.pareto(5, 60)}))
    tight = bayes(["y ~ 1", "~ 1"], df, GPD(), PriorSpec(named={"xi:(Intercept)": (0.2, 0.001)}), **FEW)
    assert abs(tight.coef()[1] - 0.2) < 0.003
    through = gam(["y ~ 1", "~ 1"], df, GPD(), priors=PriorSpec(named={"xi:(Intercept)": (0.2, 0.001)}), nsamples=50, warmup=50)
    assert abs(through.coef()[1] - 0.2) < 0.005
    for bad in (lambda: gam(["y ~ 1", "~ 1"], df, GPD(), priors=True, offset="y"), lambda: bayes(["y ~ 1"] * 3, df, GPD()), lambda: bayes("y ~ 1", df, "tw")):
        with pytest.raises(ValueError):
            bad()


def test_rows_with_equal_covariates_go_together_where_the_likelihood_is_quadratic(spark):
    rng = np.random.default_rng(23)
    n = 900
    x, w = rng.integers(0, 6, n).astype(float), rng.integers(0, 3, n).astype(float)
    t = pd.DataFrame({"x": x, "w": w, "y": 50 + rng.normal(1 + x / 2, np.exp(-1 + x / 6))})
    df = spark.createDataFrame(pd.concat([t, pd.DataFrame({"x": [9.0], "w": [0.0], "y": [51.0]})])).repartition(3)
    few = dict(nsamples=20, nchains=2, warmup=10)
    for weights in (None, "w"):
        near, far = (bayes(["y ~ x", "~ x"], df, GaussianLS(), weights=weights, gam_control=GamControl(local_rows=k), **few) for k in (5_000, 20))
        assert isinstance(far.fit.rows, LocalRows) and (near.fit.rows.n, far.fit.rows.n) == (n + 1, 14)
        assert np.allclose(near.fit.beta, far.fit.beta, atol=1e-8) and near.fit.nll == pytest.approx(far.fit.nll, rel=1e-9)
        assert np.allclose(near.draws, far.draws, atol=1e-6) and near.accepted == pytest.approx(far.accepted, abs=1e-6)
    near, far = (gamlss(["y ~ s(x, k=5, bs='cr')", "~ x"], df, GaussianLS(), control=GamControl(local_rows=k)) for k in (5_000, 20))
    assert far.rows.n == 14 and np.allclose(near.beta, far.beta, atol=1e-5) and near.nll == pytest.approx(far.nll, rel=1e-8)
    held = gamlss(["y ~ x", "~ x"], df, GaussianLS(), control=GamControl(local_rows=5))
    assert isinstance(held.rows, SparkRows) and held.rows.n == 14
