"""Models written to a table and read back."""

import numpy as np
import pandas as pd
import pytest

from smoothlake.operators.gam import gam
from smoothlake.operators.model import load


def test_a_saved_model_predicts_as_before(spark, tmp_path):
    rng = np.random.default_rng(61)
    x = rng.random(200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": [f"g{i % 3}" for i in range(200)], "y": rng.poisson(np.exp(1 + np.sin(6 * x))).astype(float)}))
    m = gam("y ~ g + s(x, k=6)", df, "poisson")
    m.save(str(tmp_path / "model"))
    again = load(spark, str(tmp_path / "model"))
    a, b = (k.predict(df, se=True).toPandas().sort_values(["x", "y"]) for k in (m, again))
    assert np.array_equal(a.fit, b.fit) and np.array_equal(a.se_fit, b.se_fit)
    assert again.aic() == m.aic() and again.coefnames() == m.coefnames() and str(again) == str(m)
    assert '"poisson"' in spark.read.parquet(str(tmp_path / "model")).first().description
    with pytest.raises(Exception):
        m.save(str(tmp_path / "model"))  # nothing is overwritten
