"""The general optimizer: derivatives, agreement with iterated working models, and the criterion's gradient."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from smoothlake.operators.families import LINKS, family_of, link
from smoothlake.operators.gam import GamControl, _rows, bam, gam, prepare
from smoothlake.operators.general import FAMILIES, GeneralFit, eta_derivatives, positive
from smoothlake.plans.design import bind
from smoothlake.plans.formula import parse


@pytest.mark.parametrize("name", LINKS)
def test_third_derivatives_of_links(name):
    e, h = np.linspace(0.3, 1.9, 9), 1e-4
    lk = link(name)
    assert np.allclose((lk.d2(e + h) - lk.d2(e - h)) / (2 * h), lk.d3(e), rtol=1e-5, atol=1e-6)


@pytest.mark.parametrize("name", FAMILIES)
def test_derivatives_of_likelihoods(name):
    for lk in family_of(name).links:
        f = family_of(name, lk)
        mu = np.linspace(0.2, 0.8, 7)
        eta, y, w, h = f.link.g(mu), np.linspace(0.15, 0.9, 7)[::-1], np.linspace(0.5, 2, 7), 1e-4
        at = lambda e, k: eta_derivatives(f, y, f.link.inv(e), e, w)[k]  # noqa: E731, B023
        dev = lambda e: -f.deviance(y, f.link.inv(e), w) / 2  # noqa: E731, B023
        assert np.allclose((dev(eta + h) - dev(eta - h)) / (2 * h), at(eta, 0), rtol=1e-5, atol=1e-6), lk
        for k in (0, 1):
            assert np.allclose((at(eta + h, k) - at(eta - h, k)) / (2 * h), at(eta, k + 1), rtol=1e-4, atol=1e-5), (lk, k)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x, z = rng.random((2, 500)).round(2)
    m = np.exp(np.sin(6 * x) + 0.5 * z)
    cols = [x, z, rng.normal(m, 0.7), rng.poisson(m), rng.binomial(1, m / (1 + m)), rng.gamma(3, m / 3), rng.wald(m, 4), 1 + rng.integers(0, 2, 500)]
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols, strict=True)], ", ".join(f"{c} double" for c in ("x", "z", "normal", "poisson", "binomial", "gamma", "inverse_gaussian", "w"))).repartition(3)


CASES = [("normal", None), ("poisson", None), ("poisson", "sqrt"), ("binomial", None), ("binomial", "cloglog"), ("gamma", "log"), ("inverse_gaussian", "log")]


@pytest.mark.parametrize("family,lk", CASES)
def test_general_agrees_with_working_models(table, family, lk):
    formula = f"{family} ~ s(x, k=8, bs='cr') + s(z, k=5)"
    a, b = gam(formula, table, family, lk, control=GamControl(epsilon=1e-10)), gam(formula, table, family, lk, optimizer="general")
    assert b.converged
    # canonical links: the same criterion but for the information that REML of the working model keeps fixed
    assert abs(a.deviance / b.deviance - 1) < 0.01 and abs(a.model_edf() - b.model_edf()) < 0.7
    if family == "normal":
        assert np.abs(a.beta - b.beta).max() < 1e-3 and abs(a.scale - b.scale) < 1e-4


def fitted(table, family, lk, formula, weights="w"):
    f, fam = parse(formula), family_of(family, lk)
    narrow, n, _ = prepare(table, f, weights, None, "fail")
    rows = _rows(narrow, n, f, fam, GamControl(), None, weights)
    return GeneralFit(bind(f, rows), rows, narrow, fam, GamControl(epsilon=1e-11), n)


@pytest.mark.parametrize("family,lk", [("poisson", "sqrt"), ("binomial", "cloglog"), ("gamma", "log"), ("inverse_gaussian", "log")])
def test_the_gradient_is_that_of_the_criterion(table, family, lk):
    g = fitted(table, family, lk, f"{family} ~ s(x, k=6, bs='cr') + s(z, k=5)")
    g.begin()
    rho = g.rho + np.array([0.4, -0.7])
    value = lambda r: (g.criterion(r, *g.settle(r, g.beta)))[0]
    beta, sums = g.settle(rho, g.beta)
    g.beta = beta
    _, scale = g.criterion(rho, beta, sums)
    grad, moves = g.gradient(rho, beta, sums, scale)
    for j, h in enumerate(np.eye(2) * 1e-3):
        assert (value(rho + h) - value(rho - h)) / 2e-3 == pytest.approx(grad[j], rel=2e-3, abs=2e-3)
        assert np.allclose((g.settle(rho + h, beta)[0] - g.settle(rho - h, beta)[0]) / 2e-3, moves[:, j], atol=1e-3 * (1 + np.abs(moves).max()))


def test_paths_agree_and_arguments_are_checked(table):
    formula = "poisson ~ s(x, k=6, bs='cr')"
    a = gam(formula, table, "poisson", optimizer="general")
    b = gam(formula, table, "poisson", optimizer="general", control=GamControl(local_rows=0))
    assert np.allclose(a.beta, b.beta, atol=1e-5) and a.aic() == pytest.approx(b.aic(), abs=1e-5) and a.criterion == pytest.approx(b.criterion, abs=1e-6)
    c = gam(formula, table, "poisson", optimizer="general", start=a.beta)
    assert np.allclose(a.beta, c.beta, atol=1e-4) and c.passes <= a.passes
    d = gam(formula, table, "poisson", start=a.beta)
    assert abs(d.deviance - a.deviance) < 0.01 * a.deviance
    for bad in (dict(optimizer="newton"), dict(optimizer="general", method="GCV"), dict(start=[1.0]), dict(family="nb", optimizer="general")):
        with pytest.raises(ValueError):
            gam(formula, table, **{"family": "poisson"} | bad)


def test_fixed_smoothing_and_no_smooths(table):
    free = gam("poisson ~ x", table, "poisson", optimizer="general")
    plain = gam("poisson ~ x", table, "poisson", control=GamControl(epsilon=1e-12))
    assert np.allclose(free.beta, plain.beta, atol=1e-6)
    held = gam("poisson ~ s(x, k=6, bs='cr', sp=3.0)", table, "poisson", optimizer="general")
    same = gam("poisson ~ s(x, k=6, bs='cr', sp=3.0)", table, "poisson", control=GamControl(epsilon=1e-12))
    assert np.allclose(held.beta, same.beta, atol=1e-6) and held.model_edf() == pytest.approx(same.model_edf(), abs=1e-5)


def test_rows_with_little_information_stay_positive():
    assert np.linalg.eigvalsh(positive(np.array([[1.0, 0], [0, -2.0]]))).min() > 0
    a = np.array([[2.0, 0.5], [0.5, 1.0]])
    assert np.array_equal(positive(a), a)


def test_compressed_rows_give_the_same_general_fit(table):
    t = table.withColumn("x", F.round("x", 1))
    a = gam("gamma ~ s(x, k=5, bs='cr')", t, "gamma", "log", weights="w", optimizer="general")
    assert bam("gamma ~ s(x, k=5, bs='cr')", t, "gamma", "log", weights="w").n == a.n
    from smoothlake.operators.gam import BamControl

    b = gam("gamma ~ s(x, k=5, bs='cr')", t, "gamma", "log", weights="w", optimizer="general", discrete=BamControl())
    assert np.allclose(a.beta, b.beta, atol=1e-5) and a.loglikelihood() == pytest.approx(b.loglikelihood(), abs=1e-4)
