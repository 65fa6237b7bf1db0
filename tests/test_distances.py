"""Distances of grid points from the nearest rows, against all pairs."""

import numpy as np
import pandas as pd

from smoothlake.operators.diagnostics import row_distances, vis_gam
from smoothlake.operators.gam import GamControl, gam


def test_distances_equal_brute_force_on_both_paths(spark):
    rng = np.random.default_rng(51)
    x = np.concatenate([rng.normal(0, 0.1, 200), rng.normal(3, 0.2, 200)])
    z = np.concatenate([rng.normal(5, 0.3, 200), rng.normal(1, 0.1, 200)])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "y": rng.normal(size=400)})).repartition(5)
    for rows in (1000, 0):
        m = gam("y ~ s(x, k=5) + s(z, k=5)", df, control=GamControl(local_rows=rows))
        ga, gb, got = row_distances(m, ("x", "z"), 17)
        want = np.sqrt((((ga[:, None, None] - x) / np.ptp(x)) ** 2 + ((gb[None, :, None] - z) / np.ptp(z)) ** 2).min(axis=2))
        assert np.allclose(got, want, atol=1e-12)
        seen = vis_gam(m, ("x", "z"), 17, too_far=0.1).toPandas()
        assert seen.fit.notna().sum() == (want <= 0.1).sum() and len(seen) == 17 * 17
