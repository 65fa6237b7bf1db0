"""Invariants of the bases: partitions of unity, null spaces of penalties, constraints, agreement with direct formulas."""

import numpy as np
import pytest

from smoothlake.operators import bases as b
from smoothlake.plans.design import bind
from smoothlake.plans.formula import Formula, parse, s, te, ti
from smoothlake.sources.rows import LocalRows

rng = np.random.default_rng(0)
N = 400
COLS = {"x": rng.uniform(0, 2, N), "z": rng.uniform(-1, 1, N), "g": np.array([f"g{i}" for i in rng.integers(0, 4, N)], object), "y": rng.normal(size=N), "__w": np.ones(N)}
ROWS = LocalRows(COLS)


@pytest.mark.parametrize("bs", ["cr", "cs", "ps", "bs", "ad", "spde", "cc", "cps"])
def test_partition_of_unity(bs):
    assert np.allclose(b.make(s("x", bs=bs, k=9), ROWS).raw(COLS).sum(1), 1)


@pytest.mark.parametrize("bs,space", [("cr", 2), ("ps", 2), ("bs", 2), ("tp", 2), ("cc", 1), ("cps", 1)])
def test_null_space_reproduces_polynomials(bs, space):
    basis = b.make(s("x", bs=bs, k=9), ROWS)
    x = basis.raw(COLS)
    for p in range(space):
        c = np.linalg.lstsq(x, COLS["x"] ** p, rcond=None)[0]
        assert np.allclose(x @ c, COLS["x"] ** p, atol=1e-8)
        assert abs(c @ basis.penalties[0] @ c) < 1e-6 * np.abs(basis.penalties[0]).max() * max(1, c @ c)
    rank = np.linalg.matrix_rank(basis.penalties[0], tol=1e-8 * np.abs(basis.penalties[0]).max())
    assert basis.width - rank == basis.null_dim == space


def test_cubic_interpolates_and_matches_its_penalty():
    basis = b.make(s("x", bs="cr", k=7), ROWS)
    assert np.allclose(basis.raw({"x": basis.knots}), np.eye(7), atol=1e-12)
    c = rng.normal(size=7)
    t = np.linspace(basis.knots[0], basis.knots[-1], 20001)
    f = basis.raw({"x": t}) @ c
    h = t[1] - t[0]
    d2 = np.diff(f, 2) / h**2
    assert np.isclose((d2**2).sum() * h, c @ basis.penalties[0] @ c, rtol=1e-2)


def test_derivative_penalty_is_the_integral():
    basis = b.make(s("x", bs="bs", k=9), ROWS)
    t = np.linspace(basis.lo, basis.hi, 40001)
    c = rng.normal(size=basis.width)
    d2 = b.bspline_derivative(t[:-1], basis.knots, basis.degree, 2) @ c
    assert np.isclose((d2**2).mean() * (basis.hi - basis.lo), c @ basis.penalties[0] @ c, rtol=1e-3)


def test_cyclic_ends_meet():
    for bs in ("cc", "cps"):
        basis = b.make(s("x", bs=bs, k=8), ROWS)
        lo, hi = (basis.knots[0], basis.knots[-1]) if bs == "cc" else (basis.lo, basis.hi)
        assert np.allclose(basis.raw({"x": np.array([lo])}), basis.raw({"x": np.array([hi])}), atol=1e-9)


@pytest.mark.parametrize("kind", b.SHAPES)
def test_shapes(kind):
    basis = b.make(s("x", bs=kind, k=9), ROWS)
    t = np.linspace(basis.lo, basis.hi, 400)
    f = basis.raw({"x": t}) @ np.exp(rng.normal(size=basis.sigma.shape[1]))
    d1, d2 = np.diff(f), np.diff(f, 2)
    if kind.startswith("mi") or kind == "mpi":
        assert (d1 >= -1e-10).all()
    if kind.startswith("md") or kind == "mpd":
        assert (d1 <= 1e-10).all()
    if kind.endswith("cx"):
        assert (d2 >= -1e-10).all()
    if kind.endswith("cv"):
        assert (d2 <= 1e-10).all()


def test_adaptive_weights_sum_to_the_plain_penalty():
    a, p = b.make(s("x", bs="ad", k=12), ROWS), b.make(s("x", bs="ps", k=12), ROWS)
    assert len(a.penalties) == 5 and np.allclose(sum(a.penalties), p.penalties[0])


def test_factor_bases():
    basis = b.make(s("g", bs="re"), ROWS)
    assert basis.raw({"g": np.array(["g1", "new"], object)}).tolist() == [[0, 1, 0, 0], [0, 0, 0, 0]]
    m = b.make(s("g", bs="mrf", xt={"nb": {"g0": ["g1"], "g1": ["g2"], "g2": ["g3"]}}), ROWS)
    assert np.allclose(m.penalties[0].sum(1), 0) and m.penalties[0][1, 1] == 2
    fs, sz = b.make(s("x", "g", bs="fs", k=5), ROWS), b.make(s("x", "g", bs="sz", k=5), ROWS)
    assert fs.width == 20 and sz.width == 15
    x = {"x": np.full(4, 0.7), "g": np.array(["g0", "g1", "g2", "g3"], object)}
    assert np.allclose((sz.raw(x) @ rng.normal(size=15)).sum(), 0)


def test_tensor_products():
    t = b.make(te("x", "z", bs="spde", k=5), ROWS)
    one = [b.make(s(v, bs="spde", k=5), ROWS).raw(COLS) for v in "xz"]
    assert np.allclose(t.raw(COLS), (one[0][:, :, None] * one[1][:, None]).reshape(N, -1))
    i = b.make(ti("x", "z", k=5), ROWS)
    assert i.width == 16


def test_fractional_powers_are_chosen():
    cols = {**COLS, "y": 3 * np.sqrt(COLS["x"]) + 2 / COLS["x"].clip(1e-3), "x": COLS["x"].clip(1e-3)}
    f = b.make(s("x", bs="fp", xt={"y": "y"}), LocalRows(cols))
    assert sorted(f.powers) == [-1.0, 0.5]


def test_soap_film_is_zero_outside_and_linear_at_heart():
    square = [[0, -1], [2, -1], [2, 1], [0, 1]]
    so = b.make(s("x", "z", bs="so", k=18, xt={"bnd": [square]}), ROWS)
    assert (so.raw({"x": np.array([5.0]), "z": np.array([0.0])}) == 0).all() and len(so.penalties) == 2


def test_sphere_depends_on_angles_only():
    p = {"la": rng.uniform(-1.5, 1.5, 100), "lo": rng.uniform(-3.1, 3.1, 100)}
    sos = b.make(s("la", "lo", bs="sos", k=20), LocalRows(p))
    assert np.allclose(sos.raw(p), sos.raw({"la": p["la"], "lo": p["lo"] + 2 * np.pi}), atol=1e-6)


def test_constraints_and_side_conditions():
    d = bind(parse("y ~ s(x, k=8) + s(z, k=6, bs='cr') + te(x, z, k=4)"), ROWS)
    x = d.matrix(COLS)
    for sm in d.smooths:
        assert np.allclose(x[:, sm.slice].sum(0), 0, atol=1e-6)
    assert np.linalg.matrix_rank(x) == d.p < 1 + 7 + 5 + 15
    by = bind(Formula("y", ("g",), True, (s("x", by="g", k=5), s("z", by="x", k=5))), ROWS)
    assert len(by.smooths) == 5 and by.p == 4 + 16 + 5
