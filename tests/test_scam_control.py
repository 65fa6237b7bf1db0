"""Options of shape-constrained fits."""

import numpy as np
import pandas as pd
import pytest

from smoothlake.operators.gam import GamControl
from smoothlake.operators.scam import ScamControl, scam, scam_control


def test_softplus_increments_fit_as_exponentials_do(spark):
    rng = np.random.default_rng(41)
    x = np.sort(rng.random(300))
    pdf = pd.DataFrame({"x": x, "y": 2 / (1 + np.exp(-12 * (x - 0.5))) + rng.normal(0, 0.1, 300), "n": rng.poisson(np.exp(1.5 * x)).astype(float)})
    df = spark.createDataFrame(pdf)
    for response, family in (("y", None), ("n", "poisson")):
        a = scam(f"{response} ~ s(x, bs='mpi', k=10)", df, family)
        b = scam(f"{response} ~ s(x, bs='mpi', k=10)", df, family, control=scam_control(not_exp=True))
        fa, fb = (m.predict(df).toPandas().sort_values("x").fit.to_numpy() for m in (a, b))
        assert (np.diff(fb) > -1e-9).all() and np.abs(fa - fb).max() < 0.08 * np.ptp(fa)
        assert abs(a.deviance / b.deviance - 1) < 0.05
        positive = b.design.positive()
        assert np.allclose(b.beta[positive], np.log1p(np.exp(b.raw_beta[positive])), rtol=1e-6)
    with pytest.raises(TypeError):
        scam_control(steps=3)


def test_plain_controls_are_taken(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": np.linspace(0, 1, 60), "y": np.linspace(0, 1, 60) ** 2}))
    assert scam("y ~ s(x, bs='mpi', k=6)", df, control=GamControl(local_rows=0)).deviance < 0.05
    assert ScamControl(outer=1, inner=2).max_iterations == 200
