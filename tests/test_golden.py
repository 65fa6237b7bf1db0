"""Fits against stored outputs of R (mgcv for ``tp`` and ``cr``, gamlss for P-splines), kept beside their inputs in
``golden``. Fixed values: the numbers below are R's."""

import os

import numpy as np
import pandas as pd
import pytest

from smoothlake.operators.gam import gam
from smoothlake.operators.gamlss import gamlss
from smoothlake.operators.multifamilies import DISTRIBUTIONS, GaussianLS

HERE = os.path.join(os.path.dirname(__file__), "golden")


def stored(spark, name):
    pdf = pd.read_csv(os.path.join(HERE, f"{name}.csv"))
    return pdf, spark.createDataFrame(pdf.assign(row=np.arange(len(pdf)))).repartition(3)


def fitted(m, df):
    return m.predict(df.select("row", *[c for c in "xz" if c in df.columns])).toPandas().sort_values("row")


@pytest.mark.parametrize(
    "column,formula,p,deviance,scale,reml,widths",
    [
        ("m1", "y ~ s(x, k=8) + s(x, z, k=25)", 31, 24.2004254980789, 0.0874438231697063, 98.3912999608234, [7, 23]),
        ("m2", "y ~ s(x, k=8) + s(z, k=8) + te(x, z, k=5)", 37, 24.4764587541521, 0.0857475007441159, 79.6799214915473, [7, 7, 22]),
        ("m3", "y ~ s(x, k=8) + s(z, k=8) + ti(x, z, k=5)", 31, 24.4810703860275, 0.0857597515412292, 80.3515112161189, [7, 7, 16]),
    ],
)
def test_nested_smooths(spark, column, formula, p, deviance, scale, reml, widths):
    pdf, df = stored(spark, "nested")
    m = gam(formula, df)
    assert m.design.p == p and [s.width for s in m.design.smooths] == widths
    assert abs(m.deviance - deviance) < 0.01 and abs(m.scale - scale) < 1e-3 and abs(m.criterion - reml) < 0.1
    assert np.abs(fitted(m, df).fit.to_numpy() - pdf[column]).max() < 0.01


def test_thin_plate_curve(spark):
    pdf, df = stored(spark, "curve")
    m = gam("y ~ s(x, k=30, bs='tp')", df)
    assert abs(m.deviance - 23.420555525862) < 1e-3 and abs(m.model_edf() - 10.2153948235665) < 1e-2
    assert np.abs(fitted(m, df).fit.to_numpy() - pdf.tp).max() < 1e-3
    mesh = gam("y ~ s(x, k=30, bs='spde')", df)
    assert np.corrcoef(fitted(mesh, df).fit, pdf.tp)[0, 1] > 0.999


@pytest.mark.parametrize(
    "name,family,bs,nll",
    [("gaussian", GaussianLS(), "cr", 698.847350445923), ("gaussian", GaussianLS(), "tp", 698.783821537062), ("gamma", DISTRIBUTIONS["gamma"](), "cr", 342.733060957666), ("gamma", DISTRIBUTIONS["gamma"](), "tp", 342.556737429062)],
)
def test_location_scale(spark, name, family, bs, nll):
    pdf, df = stored(spark, name)
    m = gamlss([f"y ~ s(x, k=20, bs='{bs}')", f"~ s(x, k=10, bs='{bs}')"], df, family)
    p = fitted(m, df)
    assert m.converged and abs(m.nll - nll) < 0.002 * nll
    for parameter in ("mu", "sigma"):
        assert np.abs(p[parameter].to_numpy() - pdf[f"{bs}_{parameter}"]).max() < 0.02


@pytest.mark.parametrize("name,family,nll", [("gaussian_ps", GaussianLS(), 699.347001383431), ("gamma_ps", DISTRIBUTIONS["gamma"](), 417.002737901638)])
def test_location_scale_by_cycles(spark, name, family, nll):
    pdf, df = stored(spark, name)
    m = gamlss(["y ~ s(x, k=23, bs='ps')", "~ s(x, k=11, bs='ps')"], df, family, method="rs")
    p = fitted(m, df)
    assert m.converged and abs(m.nll - nll) < 0.1 * nll
    assert np.corrcoef(p.mu, pdf.mu)[0, 1] > 0.99 and np.corrcoef(p.sigma, pdf.sigma)[0, 1] > 0.95
