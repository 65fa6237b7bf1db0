"""What is done row by row or over whole columns, against direct computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from smoothlake.operators import diagnostics, knots, qgam
from smoothlake.operators.families import Tweedie
from smoothlake.operators.gam import gam

rng = np.random.default_rng(3)


def test_appraise_ranks_over_many_ranges(spark):
    df = spark.range(0, 60_000, 1, 12).select((F.xxhash64("id") % 20_011 / 97.0).alias("y"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        a = diagnostics.appraise(gam("y ~ 1", df), "response").toPandas().sort_values(["resid", "prob"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose(a.prob, (np.arange(1, 60_001) - 0.5) / 60_000)


def test_offsets_are_kept_with_random_effects_and_priors(spark):
    n = 400
    x, level = rng.uniform(0, 1, n), rng.integers(0, 8, n)
    t = pd.DataFrame({"x": x, "g": [f"g{i}" for i in level], "o": 5.0 + x, "y": 5.5 + 3 * x + 0.3 * level + rng.normal(0, 0.1, n)})
    t["d"] = t.y - t.o
    df = spark.createDataFrame(t)
    with_offset, direct = gam("y ~ x + (1 | g)", df, offset="o"), gam("d ~ x + (1 | g)", df)
    assert np.allclose(with_offset.fit.beta if hasattr(with_offset, "fit") and hasattr(with_offset.fit, "beta") else with_offset.beta, direct.fit.beta if hasattr(direct, "fit") and hasattr(direct.fit, "beta") else direct.beta, atol=1e-6)
    a, b = (gam(f, df, offset=o, priors=True, nsamples=200, nchains=1).coef() for f, o in (("y ~ x", "o"), ("d ~ x", None)))
    assert np.allclose(a, b, atol=1e-6)
    with pytest.raises(TypeError, match="nonsense"):
        gam("y ~ x", df, nonsense=3)
    with pytest.raises(ValueError, match="optimizer"):
        gam("y ~ x", df, optimizer="nonsense")


def test_interior_knots_and_bins(spark):
    df = spark.createDataFrame([(float(i % 11),) for i in range(50)] + [(None,)], "x double")
    assert [r.knot for r in knots.knot_quantiles(df, "x", 3).orderBy("knot_id").collect()] == [2.5, 5.0, 7.5]
    assert knots.knot_quantiles(df, "x", 0).count() == 0
    few = knots.discretize_covariates(df, "x", 20).collect()
    assert all(r.bin_mid == r.x and (r.x is None or r.bin == int(r.x)) for r in few)
    y = rng.normal(size=500)
    many = knots.discretize_covariates(spark.createDataFrame([(float(v),) for v in y], "x double"), "x", 8).toPandas()
    breaks = np.quantile(y, np.linspace(0, 1, 9))
    middles = (breaks[1:] + breaks[:-1]) / 2
    middles[0], middles[-1] = breaks[0], breaks[-1]
    at = np.clip(np.searchsorted(breaks, many.x, "right") - 1, 0, 7)
    assert (many.bin == at).all() and np.allclose(many.bin_mid, middles[at])


def test_bootstrap_draws_rows(spark):
    w = qgam.bootstrap_weights(np.arange(20_000), 20, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    assert (np.abs(np.corrcoef(w.T) - np.eye(20)) < 0.05).all()
    # rows of equal values: the sum over replicates varies as it does for other rows
    df = spark.createDataFrame([(float(i % 2), float(i % 5)) for i in range(1000)], "x double, y double")
    m = qgam.qgam("y ~ x", df, 0.5)
    assert np.isfinite(m.lsig) and abs(m.beta[0] - 2) < 1


def test_tweedie_series_at_large_indices():
    y, scale, p = np.array([1e6, 2.0, 0.0]), 0.01, 1.5
    got = Tweedie(p=p).loglik(y, y + 0.5, np.ones(3), scale)

    def log_density(v, mu):  # all terms that matter, one by one
        a = (2 - p) / (p - 1)
        top = max(1, round(v ** (2 - p) / (scale * (2 - p))))
        z = a * math.log(v) - (1 + a) * math.log(scale) - a * math.log(p - 1) - math.log(2 - p)
        js = np.arange(max(1, top - 40 * int(math.sqrt(top)) - 40), top + 40 * int(math.sqrt(top)) + 40)
        t = np.array([j * z - math.lgamma(j + 1) - math.lgamma(a * j) for j in js.tolist()])
        return t.max() + math.log(np.exp(t - t.max()).sum()) - math.log(v) + (v * mu ** (1 - p) / (1 - p) - mu ** (2 - p) / (2 - p)) / scale

    assert np.allclose(got[:2], [log_density(v, v + 0.5) for v in y[:2].tolist()], atol=1e-5)


def test_concurvity_equals_projections(spark):
    n = 600
    a = rng.uniform(0, 1, n)
    t = pd.DataFrame({"a": a, "b": a + rng.normal(0, 0.2, n), "z": rng.normal(size=n), "y": rng.normal(size=n)})
    m = gam("y ~ z + s(a, k=5) + s(b, k=5)", spark.createDataFrame(t))
    x = m.design.matrix({c: t[c].to_numpy() for c in t})
    parts = {"parametric": x[:, : m.design.n_parametric], **{s.label: x[:, s.slice] for s in m.design.smooths}}
    for (p, q), got in diagnostics.concurvity(m, full=False).items():
        u, v = np.linalg.qr(parts[p])[0], np.linalg.qr(parts[q])[0]
        assert np.isclose(got, np.linalg.norm(v.T @ u, 2) ** 2, atol=1e-6)


def test_both_kinds_of_rows_agree(spark):
    """Points, sums and maxima of rows on the driver and on the cluster, sums beyond one packed piece."""
    from smoothlake.sources.rows import LocalRows, SparkRows

    t = {"a": rng.normal(size=6000), "b": np.round(rng.normal(size=6000), 1)}
    here, there = LocalRows(t), SparkRows(spark.createDataFrame(pd.DataFrame(t)).repartition(7), 6000)
    assert np.array_equal(here.points(["a", "b"], 500), there.points(["a", "b"], 500))
    assert np.array_equal(here.points(["b"], 5000), there.points(["b"], 5000))

    def f(cols):
        x = np.cos(np.outer(cols["a"], np.arange(120)))
        return {"g": x.T @ x, "s": np.array([cols["b"].sum()]), "max_b": np.array([cols["b"].max(), -cols["b"].min()])}

    one, two = here.sweep(f), there.sweep(f)
    assert one.keys() == two.keys() and all(one[k].shape == two[k].shape and np.allclose(one[k], two[k]) for k in one)
