"""Fits against direct computations: ridge solutions at given smoothing, independence of partitioning and of the
compressed path, recovery of known functions, contracts of errors."""

import numpy as np
import pandas as pd
import pytest

from smoothlake.operators import diagnostics, qgam
from smoothlake.operators.families import Tweedie
from smoothlake.operators.gam import BamControl, GamControl, bam, gam
from smoothlake.operators.gamlss import gamlss
from smoothlake.operators.gamm import gamm
from smoothlake.operators.multifamilies import DISTRIBUTIONS, ELF, ELFLSS, GaussianLS
from smoothlake.operators.scam import scam, solve_qp
from smoothlake.operators.smoothing import Selector, Working
from smoothlake.streaming.accumulate import StreamingGam

rng = np.random.default_rng(7)
N = 1500
x, z = rng.uniform(0, 1, N), rng.uniform(0, 1, N)
g = rng.integers(0, 10, N)
u = rng.normal(0, 0.8, 10)
f = np.sin(6 * x) + z**2
PDF = pd.DataFrame({"x": x, "z": z, "g": [f"g{i}" for i in g], "y": f + rng.normal(0, 0.3, N), "c": rng.poisson(np.exp(f)).astype(float), "b": (rng.uniform(size=N) < 1 / (1 + np.exp(-f))).astype(float), "q": rng.gamma(2, np.exp(f) / 2) + 1e-6, "r": f + u[g] + rng.normal(0, 0.3, N), "n": rng.negative_binomial(2, 2 / (2 + np.exp(f))).astype(float), "m": 2 * x**2 + rng.normal(0, 0.2, N), "k": np.round(x, 1)})


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(PDF).repartition(5).cache()


def test_fixed_smoothing_is_the_ridge_solution(df):
    m = gam("y ~ s(x, k=8, sp=0.7)", df)
    cols = {c: PDF[c].to_numpy() for c in ("x", "y")}
    xm = m.design.matrix(cols)
    s = 0.7 * m.design.unit(0)
    beta = np.linalg.solve(xm.T @ xm + s, xm.T @ cols["y"])
    assert np.allclose(beta, m.beta, rtol=1e-6, atol=1e-8)
    assert np.isclose(m.deviance, ((cols["y"] - xm @ beta) ** 2).sum(), rtol=1e-9)
    assert np.isclose(m.model_edf(), np.trace(np.linalg.solve(xm.T @ xm + s, xm.T @ xm)), atol=1e-6)


def test_reml_is_stationary(df):
    m = gam("y ~ s(x, k=8) + s(z, k=6)", df)
    sel = Selector(m.design, "REML")
    w = Working(m.gram, m.rhs, m.zz, m.n)
    now = sel.score(m.log_sp, w)
    for j in range(2):
        for h in (-0.3, 0.3):
            rho = m.log_sp.copy()
            rho[j] += h
            assert sel.score(rho, w) >= now - 1e-6


def test_cluster_rows_equal_local_rows(df):
    for family, y in (("normal", "y"), ("poisson", "c")):
        a = gam(f"{y} ~ s(x, k=8, bs='ps') + g", df, family)
        b = gam(f"{y} ~ s(x, k=8, bs='ps') + g", df.repartition(3), family, control=GamControl(local_rows=10))
        assert np.isclose(a.deviance, b.deviance, rtol=1e-8) and np.isclose(a.model_edf(), b.model_edf(), atol=1e-4)


def test_compression_is_exact(df):
    for family, y in (("normal", "y"), ("poisson", "c"), ("binomial", "b"), ("gamma", "q"), ("inverse_gaussian", "q")):
        link = "log" if y == "q" else None
        a, b = gam(f"{y} ~ s(k, k=6, bs='cr')", df, family, link), bam(f"{y} ~ s(k, k=6, bs='cr')", df, family, link)
        assert b.rows.n <= 11 and b.n == a.n
        assert np.isclose(a.deviance, b.deviance, rtol=1e-6) and np.isclose(a.scale, b.scale, rtol=1e-4)
        assert np.isclose(a.model_edf(), b.model_edf(), atol=1e-2)
    binned = bam("y ~ s(x, k=8, bs='cr')", df, bam_ctrl=BamControl(max_unique=60))
    assert binned.rows.n <= 60 and abs(binned.model_edf() - gam("y ~ s(x, k=8, bs='cr')", df).model_edf()) < 0.5


@pytest.mark.parametrize("family,y,link", [("normal", "y", None), ("poisson", "c", None), ("binomial", "b", None), ("gamma", "q", "log"), ("nb", "n", None)])
def test_recovers_the_function(df, family, y, link):
    m = gam(f"{y} ~ s(x) + s(z)", df, family, link)
    p = m.predict(type="link").toPandas()
    truth = np.sin(6 * p.x) + p.z**2
    assert m.converged and np.corrcoef(p.fit, truth)[0, 1] > 0.95
    fit = m.predict(df, se=True)
    assert {"fit", "se_fit"} <= set(fit.columns) and fit.where("se_fit <= 0").count() == 0


def test_criteria_and_families(df):
    for method in ("ML", "GCV", "UBRE"):
        assert 5 < gam("y ~ s(x)", df, method=method).model_edf() < 11
    tw = gam("c ~ s(x, k=6)", df, Tweedie(estimate=True))
    assert 1.0 < tw.family.p < 1.3
    assert gam("c ~ s(x, k=6)", df, "quasipoisson").scale > 1


def test_terms_by_id_fx(df):
    assert np.isclose(gam("y ~ s(x, k=8, fx=True)", df).model_edf(), 8)
    assert len(gam("y ~ s(x, id='a') + s(z, id='a')", df).log_sp) == 1
    assert len(gam("y ~ g + s(x, by=g, k=5)", df).log_sp) == 10
    assert gam("y ~ s(x, by=z, k=6)", df).deviance_explained() > 0.3


def test_accessors(df):
    m = gam("y ~ g + s(x)", df)
    assert m.coeftable().count() == 10 and m.confint().shape == (m.design.p, 2) and "s(x)" in m.summary()
    r = m.residuals("response").toPandas()
    assert abs(r.resid.mean()) < 1e-8 and np.isclose((r.resid**2).sum(), m.deviance, rtol=1e-6)
    assert np.isclose(m.leverage().selectExpr("sum(hat)").first()[0], m.model_edf(), rtol=1e-6)
    assert m.bic() > m.aic() and 0 < m.adjr2() < m.r2() < 1
    t = m.predict(df.withColumn("x", df.x.cast("string").cast("double")).limit(3), type="terms")
    assert len(t.first().terms) == 1


def test_nulls_and_errors(spark, df):
    odd = spark.createDataFrame([(1.0, None), (2.0, 1.0), (float("nan"), 2.0), (3.0, 3.0), (4.0, 5.0)], "y double, x double")
    with pytest.raises(ValueError, match="null"):
        gam("y ~ x", odd)
    assert gam("y ~ x", odd, na_action="drop").n == 3
    for formula, family in (("nope ~ x", None), ("y ~ s(nope)", None), ("y ~ x", "nosuch"), ("y ~ x", "poisson"), ("y ~ x", "gamma"), ("y ~ x", "beta")):
        with pytest.raises((ValueError, TypeError)):
            gam(formula, df, family)
    with pytest.raises(ValueError):
        gam("y ~ x", df, "poisson", link="logit")
    with pytest.raises(ValueError):
        gam("y ~ x", df, method="XYZ")
    p = gam("y ~ s(x, k=6)", df).predict(spark.createDataFrame([(None,), (0.5,)], "x double")).collect()
    assert p[0].fit is None and p[1].fit is not None


def test_diagnostics(df):
    m, small = gam("y ~ s(x) + s(z)", df), gam("y ~ s(z)", df)
    assert diagnostics.anova_gam(m).where("p_value > 0.01").count() == 0
    assert diagnostics.anova_gam(small, m).collect()[1].p_value < 1e-6
    assert all(v < 0.2 for v in diagnostics.concurvity(m).values())
    e = diagnostics.smooth_estimates(m, "s(x)").toPandas()
    assert np.corrcoef(e.estimate, np.sin(6 * e.x))[0, 1] > 0.99
    d = diagnostics.derivatives(m, "s(x)").toPandas()
    assert np.corrcoef(d.derivative, 6 * np.cos(6 * d.x))[0, 1] > 0.97
    wide = diagnostics.derivatives(m, "s(x)", interval="simultaneous").toPandas()
    assert (wide.upper - wide.lower > d.upper - d.lower).all()
    draws = diagnostics.posterior_samples(m, 4000)
    assert np.allclose(draws.std(0), m.stderror(), rtol=0.1)
    a = diagnostics.appraise(m).toPandas().sort_values("resid")
    assert np.allclose(a.prob, (np.arange(1, N + 1) - 0.5) / N)
    root = diagnostics.rootogram(gam("c ~ s(x) + s(z)", df, "poisson")).toPandas()
    assert root.observed.sum() == N and abs(root.expected.sum() - N) < 1
    assert diagnostics.vis_gam(m, ("x", "z"), 5).count() == 25 and diagnostics.k_check(m).count() == 2


def test_mixed_models(df):
    m = gamm("r ~ s(x) + s(z) + (1 | g)", df)
    eff = {r.level: r.effect for r in m.ranef().collect()}
    assert np.corrcoef([eff[f"g{i}"] for i in range(10)], u)[0, 1] > 0.97
    v = {r.group: r.variance for r in m.varcorr().collect()}
    assert abs(v["Residual"] - 0.09) < 0.02 and 0.2 < v["g"] < 2
    new = df.limit(1).withColumn("g", df.g.substr(1, 0))
    assert m.predict(new).first().fit is not None


def test_quantiles(df):
    for q in (0.2, 0.8):
        m = qgam.qgam("y ~ s(x, k=8) + s(z, k=5)", df, q, lsig=-1.0)
        assert abs(qgam.check_qgam(m)["proportion"] - q) < 0.05
    assert abs(qgam.pinball_loss(m.predict(), "y", "fit", 0.8) - sum(max(0.8 * (r.y - r.fit), 0.2 * (r.fit - r.y)) for r in m.predict().collect())) < 1e-6
    r = qgam.quantile_residuals(m).toPandas().resid
    assert np.isfinite(r).all()


def test_shapes_and_constraints(df):
    m = scam("m ~ s(x, bs='mpi', k=8)", df)
    p = m.predict().orderBy("x").toPandas().fit.to_numpy()
    assert (np.diff(p) >= -1e-9).all() and m.deviance_explained() > 0.8
    c = gam("m ~ s(x, bs='sc', k=8, xt=['m+', 'c+'])", df).predict().orderBy("x").toPandas()
    assert (np.diff(c.fit) >= -1e-8).all()
    pc = gam("m ~ s(x, k=8, pc=[{'at': {'x': [0.5]}, 'value': 0.0}])", df)
    assert abs(pc.design.smooths[0].columns({"x": np.array([0.5])}) @ pc.beta[pc.design.smooths[0].slice]) < 1e-8


def test_quadratic_program():
    r = np.random.default_rng(3)
    for _ in range(30):
        a = r.normal(size=(5, 5))
        gm, b, c = a @ a.T + np.eye(5), r.normal(size=5), r.normal(size=(4, 5))
        xx, _ = solve_qp(gm, b, c, np.zeros(4))
        assert (c @ xx >= -1e-7).all()
        obj = 0.5 * xx @ gm @ xx - b @ xx
        for _ in range(200):
            y = xx + r.normal(size=5) * 0.1
            if (c @ y >= 0).all():
                assert 0.5 * y @ gm @ y - b @ y >= obj - 1e-7


def test_location_scale(spark):
    r = np.random.default_rng(5)
    t = r.uniform(0, 1, 800)
    d = spark.createDataFrame(pd.DataFrame({"t": t, "y": np.sin(5 * t) + np.exp(-1 + t) * r.normal(size=800)}))
    for method in ("efs", "rs", "cg"):
        m = gamlss(["y ~ s(t)", "~ s(t, k=5)"], d, GaussianLS(), method=method)
        p = m.predict(se=True).toPandas()
        assert m.converged and np.corrcoef(p.mu, np.sin(5 * p.t))[0, 1] > 0.98 and np.corrcoef(np.log(p.sigma), p.t)[0, 1] > 0.95
    with pytest.raises(ValueError):
        gamlss(["y ~ s(t)"], d, GaussianLS())


def test_derivatives_and_densities():
    r = np.random.default_rng(2)
    families = [c() for c in DISTRIBUTIONS.values()] + [ELF(0.3, 0.2), ELFLSS(0.3, 0.2)]
    for fam in families:
        eta = [np.full(5, v) + r.normal(0, 0.1, 5) for v in fam.start(0.5, 0.3, 0.1)]
        y = r.uniform(0.2, 0.8, 5) if type(fam).__name__ != "NegBinLS" else np.arange(5.0)
        _, grad, hess = fam.derivatives(y, eta)
        for i in range(len(eta)):
            e = [v + (1e-4 if j == i else 0) for j, v in enumerate(eta)]
            d = [v - (1e-4 if j == i else 0) for j, v in enumerate(eta)]
            assert np.allclose(grad[i], (fam.nll_eta(y, e) - fam.nll_eta(y, d)) / 2e-4, rtol=1e-3, atol=1e-4)
            gp, gm = fam.derivatives(y, e)[1], fam.derivatives(y, d)[1]
            for j in range(len(eta)):
                assert np.allclose(hess[i][j], (gp[j] - gm[j]) / 2e-4, rtol=2e-2, atol=2e-2), type(fam).__name__
    t = np.linspace(1e-4, 400, 2_000_001)
    for name in ("gamma", "inverse_gaussian", "gpd", "egpd1", "egpd2", "egpd3", "egpd4"):
        fam = DISTRIBUTIONS[name]()
        v = np.exp(-fam.nll_eta(t, [np.full_like(t, e) for e in fam.start(1.0, 0.7, 0.1)]))
        assert abs(v.sum() * (t[1] - t[0]) - 1) < 0.02, name


def test_stream_equals_batch(df):
    s = StreamingGam("y ~ s(x, k=8)", df)
    a, b = df.randomSplit([0.5, 0.5], 3)
    s.add(a, 0)
    s.add(b, 1)
    s.add(b, 1)
    got, m = s.solve(), gam("y ~ s(x, k=8)", df)
    assert got["n"] == N and np.allclose(got["beta"], m.beta, atol=1e-5) and abs(got["edf"] - m.model_edf()) < 1e-3
