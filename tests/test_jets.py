"""Exact derivatives of families with several parameters, and extreme-value fits to stored data."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from smoothlake.functions import jets
from smoothlake.functions.jets import Jet, log1p_ratio, pairs
from smoothlake.operators import multifamilies as M
from smoothlake.operators.gam import GamControl, gam
from smoothlake.operators.gamlss import evgam, gamlss

Y = np.linspace(0.3, 2.2, 9)
CASES = [
    (M.GaussianLS(("log", "log")), Y, (0.1, 0.2)), (M.GammaLS(), Y, (0.1, -0.3)), (M.BetaLS(), Y / 3, (0.1, 1.0)), (M.NegBinLS(), np.arange(9.0), (0.5, 0.1)), (M.InverseGaussianLS(), Y, (0.1, 0.2)),
    (M.GEV(), Y, (0.8, 0.1, 0.15)), (M.GEV(), Y, (0.8, 0.1, 0.0)), (M.GEV(), Y, (0.8, 0.8, -0.2)), (M.GPD(), Y, (0.1, 0.2)), (M.GPD(), Y, (0.1, 1e-9)), (M.EGPD1(), Y, (0.1, 0.2, 0.3)), (M.EGPD2(), Y, (0.1, 0.2, 0.3, 0.1, 0.4)),
    (M.EGPD3(), Y, (0.1, 0.2, 0.3)), (M.EGPD4(), Y, (0.1, 0.2, 0.3, 0.5)), (M.ELFLSS(0.3, 0.1), Y, (0.8, 0.2)),
]


@pytest.mark.parametrize("family,y,at", CASES, ids=lambda x: type(x).__name__ if isinstance(x, M.MultiFamily) else "")
def test_jets_are_the_derivatives(family, y, at):
    etas = [np.full(len(y), v) for v in at]
    f, g, h = family.derivatives(y, etas)
    assert np.allclose(f, family.nll_eta(y, etas), atol=1e-12)

    def moved(i, d):
        return family.derivatives(y, [e + d * (j == i) for j, e in enumerate(etas)])

    four = lambda get, i, s=1e-3: (8 * (get(moved(i, s)) - get(moved(i, -s))) - (get(moved(i, 2 * s)) - get(moved(i, -2 * s)))) / (12 * s)
    for i in range(len(at)):
        assert np.allclose(four(lambda r: r[0], i), g[i], atol=1e-8)
        for j in range(len(at)):
            assert np.allclose(four(lambda r, j=j: r[1][j], i), h[i][j], atol=1e-8)


def test_pareto_and_extreme_value_gradients_are_the_closed_forms():
    psi, xi = 0.3, 0.25
    z = Y * np.exp(-psi)
    _, g, h = M.GPD().derivatives(Y, [np.full(9, psi), np.full(9, xi)])
    assert np.allclose(g[0], 1 - (1 + xi) * z / (1 + xi * z), atol=1e-12)
    assert np.allclose(g[1], (1 + 1 / xi) * z / (1 + xi * z) - np.log1p(xi * z) / xi**2, atol=1e-12)
    assert np.allclose(h[0][0], (1 + xi) * z / (1 + xi * z) ** 2, atol=1e-12)
    mu = 0.4
    z = (Y - mu) * np.exp(-psi)
    t = 1 + xi * z
    _, g, _ = M.GEV().derivatives(Y, [np.full(9, mu), np.full(9, psi), np.full(9, xi)])
    assert np.allclose(g[0], np.exp(-psi) * (t ** (-1 / xi) - 1 - xi) / t, atol=1e-12)
    assert np.allclose(g[1], 1 + z * (t ** (-1 / xi) - 1 - xi) / t, atol=1e-12)


def test_large_derivatives_are_not_cut_off_and_rows_outside_the_support_are_marked():
    _, g, h = M.GaussianLS(("log", "log")).derivatives(np.array([1e6]), [np.array([0.0]), np.array([-2.0])])
    assert h[1][1][0] == pytest.approx(2 * (1e6 - 1) ** 2 * np.exp(4), rel=1e-9) and h[1][1][0] > 1e8
    f, g, h = M.GPD().derivatives(np.array([5.0, 0.1]), [np.zeros(2), np.full(2, -0.5)])
    assert f[0] == M.BAD and g[0][0] == 0 and h[0][0][0] == 0 and f[1] < 1


def test_arithmetic_of_jets():
    x, y = Jet.variables([np.array([0.7]), np.array([1.9])])
    at = lambda f: f(x, y).parts()
    v, g, h = at(lambda a, b: (2 - a) * b**3 / (1 + a) - a / 3 + 4 / b)
    assert v[0] == pytest.approx(1.3 * 1.9**3 / 1.7 - 0.7 / 3 + 4 / 1.9)
    assert g[0][0] == pytest.approx(-3 / 1.7**2 * 1.9**3 - 1 / 3) and g[1][0] == pytest.approx(3 * 1.3 * 1.9**2 / 1.7 - 4 / 1.9**2)
    assert h[0][1][0] == pytest.approx(-3 / 1.7**2 * 3 * 1.9**2) and h[1][1][0] == pytest.approx(6 * 1.3 * 1.9 / 1.7 + 8 / 1.9**3)
    assert pairs(3) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    u = np.array([-0.5, -0.011, -0.009, -1e-12, 0.0, 1e-9, 0.009, 0.011, 3.0])
    q, d1, d2 = jets._log1p_ratio_parts(u)
    assert np.allclose(q, np.where(u == 0, 1, np.log1p(u) / np.where(u == 0, 1, u)), atol=1e-15) and np.allclose(d1[[3, 4]], -0.5) and np.allclose(d2[[3, 4]], 2 / 3)
    assert abs(d2[1] - d2[2]) < 0.01 and abs(d2[6] - d2[7]) < 0.01  # no step where the series takes over
    picked = jets.where(np.array([True]), x * y, 3.0)
    assert picked.parts()[2][0][1][0] == 1 and float(log1p_ratio(0.0)) == 1


def stored(spark, name):
    return spark.createDataFrame(pd.read_csv(os.path.join(os.path.dirname(__file__), "golden", f"{name}.csv"))).repartition(3)


def test_stored_block_maxima(spark):
    """The likelihood and the score printed beside these data."""
    df = stored(spark, "gev")
    m = evgam(["y ~ s(x, k=10, bs='cr')", "~ s(x, k=8, bs='cr')", "~ 1"], df, M.GEV())
    assert m.converged and abs(m.nll - 687.46) < 0.01 * 687.46 and abs(m.laml - 724.93) < 0.02 * 724.93
    got = m.predict(df).toPandas()
    assert np.corrcoef(got.mu, 5 + 2 * np.sin(2 * np.pi * got.x))[0, 1] > 0.99 and abs(got.xi.iloc[0] - 0.1) < 0.1
    eta = m.param_eta("psi", df).toPandas()
    assert np.allclose(eta.sort_values("x").eta, got.sort_values("x").psi)


def test_stored_excesses(spark):
    """Fixed value: the likelihood printed beside these data."""
    m = evgam(["y ~ s(x, k=10, bs='cr')", "~ 1"], stored(spark, "gpd"), M.GPD())
    assert m.converged and abs(m.nll - 803.77) < 0.01 * 803.77


def test_offsets_of_several_predictors(spark):
    rng = np.random.default_rng(3)
    x = rng.random(400)
    a, b = rng.normal(size=(2, 400)).round(2) / 2
    y = rng.normal(1 + x + a, np.exp(-0.5 + b))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, a, b, y, strict=True)], "x double, a double, b double, y double")
    m = gamlss(["y ~ x", "~ 1"], df, M.GaussianLS(), offset=["a", "b"])
    moved = gamlss(["u ~ x", "~ 1"], df.withColumn("u", F.col("y") - F.col("a")), M.GaussianLS(), offset=[None, "b"], control=GamControl(local_rows=0))
    assert np.allclose(m.beta, moved.beta, atol=1e-4) and abs(m.beta[2] + 0.5) < 0.1
    p = m.predict(df).toPandas()
    assert np.allclose(p.mu, m.beta[0] + m.beta[1] * p.x + p.a) and np.allclose(p.sigma, np.exp(m.beta[2] + p.b))
    one = gam(["y ~ x", "~ 1"], df, M.GaussianLS(), offset="a")
    assert np.allclose(one.beta, gamlss(["y ~ x", "~ 1"], df, M.GaussianLS(), offset=["a", None]).beta)
    with pytest.raises(ValueError):
        gamlss(["y ~ x", "~ 1"], df, M.GaussianLS(), offset=["a"])
