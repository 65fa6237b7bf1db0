import pytest

from smoothlake.plans.formula import parse, s, te


def test_terms():
    f = parse("y ~ x1 + s(x2, k=20, bs='cr') + te(a, b) + (1 | g) + 0")
    assert f.response == "y" and f.parametric == ("x1",) and not f.intercept
    assert [x.label for x in f.smooths] == ["s(x2)", "te(a,b)"] and f.smooths[0].k == 20 and f.smooths[0].bs == "cr"
    assert f.random[0].terms == ("1",) and f.random[0].group == ("g",)
    assert f.columns == ["y", "x1", "x2", "a", "b", "g"]


def test_shorthands():
    assert parse("y ~ s(x, 15)").smooths[0].k == 15
    assert parse("y ~ cr(x)").smooths[0].bs == "cr" and parse("y ~ cps(x, k=8)").smooths[0].bs == "cps"
    assert parse("y ~ re(g, x)").random[0].terms == ("1", "x")
    assert [r.group for r in parse("y ~ (1 | a/b)").random] == [("a",), ("a", "b")]
    assert parse("y ~ (0 + x | g)").random[0].terms == ("x",)
    assert parse("y ~ s(x, sp=2.0, fx=True, by=z)").smooths[0].by == "z"
    assert te("a", "b", bs=["cr", "ps"], k=[4, 5]).k == (4, 5)


@pytest.mark.parametrize("bad", ["y ~ s(x, bs='zz')", "y ~ s(x, k=2)", "y ~ s(x", "y ~ s()", "y ~ x ! z", "y x"])
def test_errors(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_spec_is_plain_data():
    assert s("x", bs="ps") == s("x", bs="ps")
