"""Sums in levels, exact order statistics, one likelihood at any size, and the release of held tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from smoothlake.operators import diagnostics
from smoothlake.operators.gam import GamControl, bam, gam
from smoothlake.operators.knots import discretize_covariates, knot_quantiles, place_knots
from smoothlake.sources import rows
from smoothlake.sources.rows import SparkRows, levels, order_statistics


def test_levels_have_a_bounded_fan_in():
    assert [levels(t) for t in (1, 64, 65, 4096, 4097, 100_000)] == [1, 1, 2, 2, 3, 3]
    for tasks in (65, 10_000, 250_000):
        left = tasks
        for _ in range(levels(tasks)):
            left = -(-left // rows.FAN)
        assert left == 1


def test_sums_of_many_tasks_and_wide_matrices(spark, monkeypatch):
    monkeypatch.setattr(rows, "FAN", 3)
    df = spark.range(0, 4000, 1, 40).select(F.col("id").cast("double").alias("x"))

    def block(cols):
        x = cols["x"]
        m = np.stack([np.sin(x * (k + 1)) for k in range(300)], axis=1)
        return {"g": m.T @ m, "max_x": np.array([x.max()]), "n": np.array([len(x)])}

    r = SparkRows(df, 4000)
    got, want = r.sweep(block), block({"x": np.arange(4000.0)})
    assert r.tasks == 40 and levels(40) == 4
    assert np.allclose(got["g"], want["g"], atol=1e-8) and got["max_x"] == 3999 and got["n"] == 4000


def test_order_statistics_are_exact_and_dealt_out(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=5000).round(2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        probs = [0.0, 0.013, 0.25, 0.5, 0.777, 1.0]
        distinct = df.where("x is not null").distinct()
        assert np.allclose(order_statistics(distinct.withColumn("n", F.lit(1)), probs), np.quantile(np.unique(x), probs), atol=1e-12)
        counted = df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        assert np.allclose(order_statistics(counted, probs), np.quantile(x, probs), atol=1e-12)
        sizes = [r[0] for r in distinct.repartitionByRange(16, "x").groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert max(sizes) < sum(sizes) / 8
        assert [r.knot for r in place_knots(df, "x", 5).collect()] == pytest.approx(np.quantile(np.unique(x), np.linspace(0, 1, 5)))
        assert [r.knot for r in knot_quantiles(df, "x", 3).collect()] == pytest.approx(np.quantile(np.unique(x), [0.25, 0.5, 0.75]))
        assert place_knots(df.where("x > 1e9"), "x", 5).collect() == [] == knot_quantiles(df, "x", 0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    binned = discretize_covariates(df.where("x is not null"), "x", 20).groupBy("bin").count().collect()
    assert len(binned) == 20 and max(r["count"] for r in binned) < 2.2 * 5000 / 20
    assert order_statistics(spark.createDataFrame([(4.0, 3)], "x double, n long"), [0.0, 0.5, 1.0]) == [4.0, 4.0, 4.0]


@pytest.mark.parametrize("family", ["normal", "poisson", "binomial", "gamma", "inverse_gaussian", "quasipoisson"])
def test_likelihood_is_the_same_on_every_path(spark, family):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, 400) / 12
    mu = np.exp(np.sin(4 * x))
    y = {"binomial": lambda: rng.binomial(5, mu / 4) / 5, "gamma": lambda: rng.gamma(4, mu / 4), "inverse_gaussian": lambda: rng.wald(mu, 3), "normal": lambda: rng.normal(mu, 1)}.get(family, lambda: rng.poisson(mu))()
    df = spark.createDataFrame([(float(a), float(b), 5.0 if family == "binomial" else 1.0 + i % 2) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, w double").repartition(3)
    fit = lambda f, **kw: f("y ~ s(x, k=5, bs='cr')", df, family, "log" if family in ("gamma", "inverse_gaussian") else None, weights="w", **kw)
    near, far = GamControl(epsilon=1e-12), GamControl(epsilon=1e-12, local_rows=0)
    models = [fit(gam, control=near), fit(bam, control=near), fit(gam, control=far), fit(bam, control=far)]
    values = [m.aic() for m in models]
    assert np.allclose(values, values[0], rtol=1e-8, atol=1e-5), values
    m = models[0]
    rows_ = m.predict(df).select("y", "w", "fit").toPandas()
    scale = 1.0 if family.removeprefix("quasi") in ("poisson", "binomial") else m.scale
    if family != "normal":
        assert m.loglikelihood() == pytest.approx(m.family.loglik(rows_.y.to_numpy(), rows_.fit.to_numpy(), rows_.w.to_numpy(), scale).sum(), rel=1e-8)
    assert models[3].state().loglikelihood() == pytest.approx(values[0] / -2 + m.dof(), rel=1e-8)


@pytest.mark.parametrize("family", ["nb", "tw", "betar"])
def test_likelihood_of_other_families_on_the_cluster(spark, family):
    rng = np.random.default_rng(9)
    x = rng.random(150)
    y = rng.beta(2, 3, 150) if family == "betar" else rng.poisson(np.exp(1 + x)).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(3)
    a, b = (gam("y ~ x", df, family, control=GamControl(local_rows=n)) for n in (1000, 0))
    assert a.aic() == pytest.approx(b.aic(), rel=1e-6)


def test_perfect_fits_have_no_finite_likelihood(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(9)], "x double, y double")
    assert gam("y ~ 1", df).loglikelihood() == float("inf")


def test_models_free_what_they_hold(spark):
    import gc

    held = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    gc.collect()
    before = held()
    df = spark.range(500).select((F.col("id") / 500).alias("x"), F.sin("id").alias("y"))
    m = gam("y ~ s(x, k=5)", df, control=GamControl(local_rows=0))
    assert held() > before
    m.close()
    assert held() == before
    m = bam("y ~ s(x, k=5)", df, control=GamControl(local_rows=0))
    del m
    gc.collect()
    assert held() == before


def test_compressed_rows_count_for_all_they_stand_for(spark):
    rng = np.random.default_rng(11)
    n = 3000
    x, z = rng.integers(0, 4, n), rng.integers(0, 3, n)
    t = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, z, rng.poisson(1 + 0.3 * x), strict=True)], "x double, z double, y double").repartition(3)
    plain, packed = gam("y ~ x + s(z, k=3, bs='cr')", t, "poisson"), bam("y ~ x + s(z, k=3, bs='cr')", t, "poisson")
    assert packed.rows.n == 12 and plain.rows.n == n
    a, b = (diagnostics.rootogram(m).toPandas() for m in (plain, packed))
    assert abs(b.expected.sum() - n) < 1 and np.allclose(a.expected, b.expected, rtol=1e-5)
    c, d = (diagnostics.concurvity(m) for m in (plain, packed))
    assert all(np.isclose(c[k], d[k], rtol=1e-6, atol=1e-9) for k in c)
