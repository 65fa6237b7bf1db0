import math

import numpy as np

from smoothlake.functions import special as f


def test_gamma_functions():
    x = np.array([0.05, 0.7, 1.0, 3.3, 12.5, 400.0])
    assert np.allclose(f.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    h = 1e-5
    assert np.allclose(f.digamma(x[1:]), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x[1:]], atol=1e-6)
    assert np.allclose(f.trigamma(x[1:]), (f.digamma(x[1:] + h) - f.digamma(x[1:] - h)) / (2 * h), rtol=1e-5)


def test_tails():
    assert np.allclose(f.normal_cdf(f.normal_ppf(np.array([1e-6, 0.2, 0.5, 0.9, 1 - 1e-6]))), [1e-6, 0.2, 0.5, 0.9, 1 - 1e-6], rtol=1e-9)
    assert abs(f.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10 and abs(f.t_sf2(2.2281388519649385, 10) - 0.05) < 1e-10
    assert abs(f.f_sf(4.102821015303716, 2, 10) - 0.05) < 1e-8 and abs(f.t_ppf(0.975, 10) - 2.2281388519649385) < 1e-8
    for n, p in ((7, 0.3), (40, 0.9)):
        cdf = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        assert all(abs(f.binomial_cdf(k, n, p) - cdf[k]) < 1e-10 for k in range(n + 1))
        assert all(f.binomial_ppf(q, n, p) == int(np.argmax(cdf >= q)) for q in (0.025, 0.5, 0.975))


def test_softplus_derivatives():
    x = np.linspace(-30, 30, 13)
    h = 1e-4
    assert np.allclose(f.softplus_d1(x), (f.softplus(x + h) - f.softplus(x - h)) / (2 * h), atol=1e-7)
    assert np.allclose(f.softplus_d2(x), (f.softplus_d1(x + h) - f.softplus_d1(x - h)) / (2 * h), atol=1e-7)
    assert np.allclose(f.softplus_d3(x), (f.softplus_d2(x + h) - f.softplus_d2(x - h)) / (2 * h), atol=1e-7)
