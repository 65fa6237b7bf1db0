import numpy as np
import pandas as pd

from smoothlake.operators.gam import gam
from smoothlake.operators.gamm import gamm
from smoothlake.operators.gamm_large import gamm_large


def test_schur_complement_equals_the_dense_fit(spark):
    rng = np.random.default_rng(4)
    n, q = 1200, 40
    x, g = rng.uniform(0, 1, n), rng.integers(0, q, n)
    u = rng.normal(0, 0.7, q)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": [f"l{i}" for i in g], "y": np.sin(6 * x) + u[g] + rng.normal(0, 0.3, n)})).repartition(3)
    a, b = gamm("y ~ s(x, k=8) + (1 | g)", df), gamm_large("y ~ s(x, k=8) + (1 | g)", df)
    va, vb = ({r.group: r.variance for r in m.varcorr().collect()} for m in (a, b))
    assert abs(va["g"] / vb["g"] - 1) < 0.05 and abs(va["Residual"] / vb["Residual"] - 1) < 0.01
    ea, eb = ({r.level: r.effect for r in m.ranef().collect()} for m in (a, b))
    assert len(ea) == len(eb) == q and max(abs(ea[k] - eb[k]) for k in ea) < 0.02
    fa, fb = (m.predict(df).orderBy("x").toPandas().fit.to_numpy() for m in (a, b))
    assert np.abs(fa - fb).max() < 0.02
    assert b.predict(df.limit(1).selectExpr("x", "'new' AS g")).first().fit is not None


def test_centred_effects_at_a_given_ratio_are_those_of_a_ridge_smooth(spark):
    rng = np.random.default_rng(8)
    n, q = 900, 25
    x, g, w = rng.uniform(0, 1, n), rng.integers(0, q, n) ** 2 // q, rng.uniform(0.5, 2, n)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": g, "w": w, "y": 3 + 2 * x + rng.normal(0, 0.7, q)[g] + rng.normal(0, 0.3, n)})).repartition(3)
    for weights in (None, "w"):
        a = gam("y ~ x + s(g, bs='re', sp=10.0)", df, weights=weights)
        b = gamm_large("y ~ x + (1 | g)", df, weights=weights, ratio=10.0, centred=True)
        (smooth,) = a.design.smooths
        want = dict(zip(smooth.basis.levels, smooth.columns({"g": np.array(smooth.basis.levels)}) @ a.beta[smooth.slice], strict=True))
        got = {r.level: r.effect for r in b.ranef().collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
        assert np.allclose(a.beta[:2], b.beta, atol=1e-9) and b.ratio == 10.0


def test_the_supplier_query_holds_no_column_per_level(spark, tmp_path, monkeypatch):
    from smoothlake import queries
    from smoothlake.operators import bases

    n = 12_000
    t = spark.range(n).selectExpr("id % 6000 AS l_suppkey", "CAST(id * 7919 % 1000 AS double) AS l_extendedprice")
    t.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(bases.OneHot, "raw", lambda *_: (_ for _ in ()).throw(AssertionError("a column per level")))
    got = queries.re_group_effects(spark, str(tmp_path)).toPandas()
    y = pd.DataFrame({"g": np.arange(n) % 6000, "y": np.arange(n) * 7919 % 1000}).groupby("g").y.mean()
    assert len(got) == 6000 and np.allclose(got.set_index("level").effect.sort_index(), (y - y.mean()) * 2 / 12, atol=6e-5)
