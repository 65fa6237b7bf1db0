"""The formula language: ``y ~ x1 + s(x2, k=20, bs='cr') + te(a, b) + (1 | g)``.

A recursive-descent parser reads a formula into plain data; nothing touches a table here.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field, replace
from typing import Any

ALIASES = ("cr", "tp", "ts", "cs", "cc", "ps", "cps")
SHAPES = ("mpi", "mpd", "cx", "cv", "micx", "micv", "mdcx", "mdcv")
BASES = ("tp", "ts", "ds", "cr", "cs", "cc", "ps", "bs", "cps", "ad", "re", "gp", "lo", "fp", "mrf", "fs", "sz", "so", "sos", "spde", *SHAPES, "sc", "scad")


@dataclass(frozen=True)
class SmoothSpec:
    """A smooth term as written. kind: s, te, ti or t2; m: order of the penalty; xt: extras of a basis;
    pc: point constraints."""

    vars: tuple[str, ...]
    bs: tuple[str, ...] | str = "tp"
    k: tuple[int, ...] | int = -1
    by: str | None = None
    id: str | None = None
    sp: tuple[float, ...] | None = None
    fx: bool = False
    m: Any = None
    xt: dict = field(default_factory=dict, hash=False)
    pc: Any = None
    kind: str = "s"

    @property
    def label(self) -> str:
        inside = ",".join(self.vars)
        return f"{self.kind}({inside})" + (f":{self.by}" if self.by else "")


@dataclass(frozen=True)
class RandomSpec:
    """``(terms | group)``: terms hold ``1`` and column names; a nested group has several columns."""

    terms: tuple[str, ...]
    group: tuple[str, ...]

    @property
    def label(self) -> str:
        return f"({'+'.join(self.terms)}|{':'.join(self.group)})"


@dataclass(frozen=True)
class Formula:
    response: str
    parametric: tuple[str, ...] = ()
    intercept: bool = True
    smooths: tuple[SmoothSpec, ...] = ()
    random: tuple[RandomSpec, ...] = ()

    @property
    def columns(self) -> list[str]:
        names = [self.response, *self.parametric]
        for s in self.smooths:
            names += [*s.vars, *([s.by] if s.by else [])]
        for r in self.random:
            names += [*[t for t in r.terms if t not in "01"], *r.group]
        return list(dict.fromkeys(n for n in names if n))


def s(*vars: str, bs: str = "tp", k: int = -1, **more) -> SmoothSpec:
    """A smooth of one or several columns."""
    return _checked(SmoothSpec(tuple(vars), bs, k, **_clean(more)))


def te(*vars: str, bs="cr", k=-1, **more) -> SmoothSpec:
    """A full tensor-product smooth."""
    return _checked(SmoothSpec(tuple(vars), bs, k, kind="te", **_clean(more)))


def ti(*vars: str, bs="cr", k=-1, **more) -> SmoothSpec:
    """A tensor-product interaction, without main effects."""
    return _checked(SmoothSpec(tuple(vars), bs, k, kind="ti", **_clean(more)))


def t2(*vars: str, bs="cr", k=-1, **more) -> SmoothSpec:
    """A tensor product with separate penalties for the margins and their product."""
    return _checked(SmoothSpec(tuple(vars), bs, k, kind="t2", **_clean(more)))


def re_(group: str, *slopes: str) -> RandomSpec:
    return RandomSpec(("1", *slopes), (group,))


def _clean(more: dict) -> dict:
    out = dict(more)
    for name in ("bs", "k"):
        if isinstance(out.get(name), list):
            out[name] = tuple(out[name])
    if out.get("sp") is not None and not isinstance(out["sp"], tuple):
        out["sp"] = tuple(out["sp"]) if isinstance(out["sp"], list) else (float(out["sp"]),)
    if out.get("xt") is None:
        out.pop("xt", None)
    elif isinstance(out["xt"], (str, list, tuple)):
        out["xt"] = {"constraints": list(out["xt"]) if not isinstance(out["xt"], str) else [out["xt"]]}
    return out


def _checked(x: SmoothSpec) -> SmoothSpec:
    if not x.vars:
        raise ValueError("a smooth needs at least one column")
    x = replace(x, bs=tuple(x.bs) if isinstance(x.bs, list) else x.bs, k=tuple(x.k) if isinstance(x.k, list) else x.k)
    for b in (x.bs,) if isinstance(x.bs, str) else x.bs:
        if b not in BASES:
            raise ValueError(f"unknown basis {b!r}; known are {', '.join(BASES)}")
    for k in (x.k,) if isinstance(x.k, int) else x.k:
        if k != -1 and k < 3 and x.bs not in ("re", "mrf"):
            raise ValueError(f"{x.label}: k must be 3 at least")
    return x


TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_][A-Za-z_0-9.]*)|(?P<number>\d+(?:\.\d+)?)|(?P<op>[~+\-|/:()*]))")


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str | None:
        m = TOKEN.match(self.text, self.at)
        return m[m.lastgroup] if m else None

    def take(self, want: str | None = None) -> str:
        m = TOKEN.match(self.text, self.at)
        if not m or (want and m[m.lastgroup] != want):
            raise ValueError(f"formula: {want or 'a term'} expected at {self.text[self.at :]!r}")
        self.at = m.end()
        return m[m.lastgroup]

    def call(self, name: str):
        """Arguments of a smooth: names, integers (k) and keywords with literals or bare names."""
        depth, start = 0, self.at
        quote = ""
        for i in range(self.at, len(self.text)):
            c = self.text[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if not depth:
                    self.at = i + 1
                    break
        else:
            raise ValueError(f"formula: {name}( is not closed")
        node = ast.parse("f" + self.text[start : self.at].strip(), mode="eval").body
        positional: list = []
        for a in node.args:
            positional.append(a.id if isinstance(a, ast.Name) else ast.literal_eval(a))
        keywords = {k.arg: (k.value.id if isinstance(k.value, ast.Name) else ast.literal_eval(k.value)) for k in node.keywords}
        columns = [p for p in positional if isinstance(p, str)]
        numbers = [p for p in positional if isinstance(p, int)]
        if numbers:
            keywords.setdefault("k", numbers[0])
        return columns, keywords

    def random(self) -> list[RandomSpec]:
        """``(1 + x | a/b)`` after its opening parenthesis."""
        terms: list[str] = []
        sign = "+"
        while True:
            t = self.take()
            if t in "+-":
                sign = t
                continue
            if t == "|":
                break
            if sign == "+":
                terms.append(t)
        group = [self.take()]
        nested = False
        while self.peek() in ("/", ":"):
            nested |= self.take() == "/"
            group.append(self.take())
        self.take(")")
        zero = "0" in terms
        names = tuple(t for t in terms if t not in "01")
        names = names if zero else ("1", *names)
        if not names:
            raise ValueError("formula: a random effect without terms")
        if nested:
            return [RandomSpec(names, tuple(group[: i + 1])) for i in range(len(group))]
        return [RandomSpec(names, tuple(group))]

    def formula(self) -> Formula:
        response = "" if self.peek() == "~" else self.take()
        self.take("~")
        parametric: list[str] = []
        smooths: list[SmoothSpec] = []
        random: list[RandomSpec] = []
        intercept, sign = True, "+"
        while self.peek() is not None:
            t = self.take()
            if t in "+-":
                sign = t
            elif t in ("0", "1"):
                intercept = (t == "1") == (sign == "+")
                sign = "+"
            elif t == "(":
                random += self.random()
            elif self.peek() == "(" and t in ("s", "te", "ti", "t2", "re", *ALIASES):
                columns, kw = self.call(t)
                if t == "re":
                    random.append(re_(*columns))
                elif t in ALIASES:
                    smooths.append(s(*columns, **{"bs": t, **kw}))
                else:
                    smooths.append({"s": s, "te": te, "ti": ti, "t2": t2}[t](*columns, **kw))
            elif re.fullmatch(r"[A-Za-z_][\w.]*", t):
                (parametric.remove if sign == "-" and t in parametric else parametric.append)(t)
                sign = "+"
            else:
                raise ValueError(f"formula: {t!r} is not understood")
        if self.text[self.at :].strip():
            raise ValueError(f"formula: {self.text[self.at :]!r} is not understood")
        return Formula(response, tuple(dict.fromkeys(parametric)), intercept, tuple(smooths), tuple(random))


def parse(text: str | Formula) -> Formula:
    return text if isinstance(text, Formula) else _Parser(text).formula()
