import numpy as np

from smoothlake import api


def test_names_resolve():
    assert len(api.__all__) > 120
    assert api.cr("x", k=5).bs == "cr" and api.cps("x").bs == "cps" and api.te("a", "b").kind == "te"


def test_family_interface():
    y = np.array([0.5, 1.0, 2.0])
    etas = [np.zeros(3), np.zeros(3)]
    total, (f, g, h) = api.nll_total(api.GaussianLS(), y, etas), api.nll_derivs(api.GaussianLS(), y, etas)
    assert np.isclose(total, f.sum()) and np.allclose(g[0], -y) and np.allclose(h[0][0], 1)
    assert api.GPD().nparams() == 2 and api.EGPD2().param_names()[-1] == "logitp"
