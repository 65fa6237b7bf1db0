"""Binding a formula to rows: columns of the model matrix, constraints, penalties, identifiability.

The bound design holds nothing of the size of the data. ``matrix`` evaluates the columns of a block of rows
and is what tasks run; constraints are applied there as small matrices.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from smoothlake.operators.bases import Basis, ShapeSpline, make, null_basis
from smoothlake.plans.formula import Formula, SmoothSpec
from smoothlake.sources.rows import row_counts, size_of


@dataclass(eq=False)
class BoundSmooth:
    spec: SmoothSpec
    basis: Basis
    turn: np.ndarray  # raw columns to columns
    label: str
    level: object = None  # of a factor ``by``
    numeric_by: bool = False
    shift: np.ndarray | None = None  # column means taken off (shape-constrained smooths)
    keep: np.ndarray | None = None  # columns left by the side constraints
    penalties: list[np.ndarray] = field(default_factory=list)
    start: int = 0

    @property
    def width(self) -> int:
        return self.turn.shape[1] if self.keep is None else len(self.keep)

    @property
    def slice(self) -> slice:
        return slice(self.start, self.start + self.width)

    def full(self, cols) -> np.ndarray:
        x = self.basis.raw(cols) @ self.turn
        if self.shift is not None:
            x = x - self.shift
        if self.numeric_by:
            x = x * np.asarray(cols[self.spec.by], float)[:, None]
        elif self.level is not None:
            x = x * (cols[self.spec.by] == self.level)[:, None]
        return x

    def columns(self, cols) -> np.ndarray:
        x = self.full(cols)
        return x if self.keep is None else x[:, self.keep]

    def positive(self) -> np.ndarray:
        p = self.basis.positive if self.basis.positive is not None else np.zeros(self.turn.shape[1], bool)
        return p if self.keep is None else p[self.keep]


@dataclass
class Factor:
    name: str
    levels: list

    def columns(self, cols) -> np.ndarray:
        return np.column_stack([(cols[self.name] == v).astype(float) for v in self.levels[1:]]) if len(self.levels) > 1 else np.zeros((size_of(cols), 0))


@dataclass
class Penalty:
    """One smoothing parameter: blocks (columns, matrix); fixed: its value where ``sp`` gives it."""

    blocks: list[tuple[slice, np.ndarray]]
    label: str
    fixed: float | None = None
    rank: int = 0


@dataclass(eq=False)
class Design:
    formula: Formula
    names: list[str]
    parametric: list[str | Factor]
    smooths: list[BoundSmooth]
    penalties: list[Penalty]
    n: int

    @property
    def p(self) -> int:
        return len(self.names)

    @property
    def n_parametric(self) -> int:
        return self.smooths[0].start if self.smooths else self.p

    def matrix(self, cols) -> np.ndarray:
        n = size_of(cols)
        parts = [np.ones((n, 1))] if self.formula.intercept else []
        for t in self.parametric:
            parts.append(t.columns(cols) if isinstance(t, Factor) else np.asarray(cols[t], float)[:, None])
        parts += [s.columns(cols) for s in self.smooths]
        return np.hstack(parts) if parts else np.zeros((n, 0))

    def penalty(self, log_sp: np.ndarray) -> np.ndarray:
        s = np.zeros((self.p, self.p))
        for rho, pen in zip(log_sp, self.penalties, strict=True):
            for at, m in pen.blocks:
                s[at, at] += np.exp(rho) * m
        return s

    def unit(self, j: int) -> np.ndarray:
        s = np.zeros((self.p, self.p))
        for at, m in self.penalties[j].blocks:
            s[at, at] += m
        return s

    def positive(self) -> np.ndarray:
        out = np.zeros(self.p, bool)
        for s in self.smooths:
            out[s.slice] = s.positive()
        return out

    def inequalities(self) -> tuple[np.ndarray, np.ndarray] | None:
        rows, rhs = [], []
        for s in self.smooths:
            if s.basis.inequality is not None:
                a, b = s.basis.inequality
                full = np.zeros((len(a), self.p))
                m = a @ s.turn
                full[:, s.slice] = m if s.keep is None else m[:, s.keep]
                rows.append(full)
                rhs.append(b)
        return (np.vstack(rows), np.concatenate(rhs)) if rows else None

    def equalities(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Point constraints: a weighted sum of the smooth at given points has a given value."""
        rows, rhs = [], []
        for s in self.smooths:
            for block in s.spec.pc or ():
                points = {v: np.atleast_1d(np.asarray(block["at"][v], float)) for v in s.spec.vars}
                weights = np.asarray(block.get("weights", np.ones(len(next(iter(points.values()))))), float)
                full = np.zeros(self.p)
                full[s.slice] = weights @ s.columns(points)
                rows.append(full)
                rhs.append(float(block.get("value", 0.0)))
        return (np.vstack(rows), np.array(rhs)) if rows else None


def _is_factor(rows, name: str) -> bool:
    c = getattr(rows, "columns", None)
    if c is not None:
        return c[name].dtype == object
    return dict(rows.df.dtypes)[name] in ("string", "boolean")


def bind(formula: Formula, rows, side: bool = True) -> Design:
    """Profiles the rows and builds the design: knots and levels, one pass for the constraints, one for nested
    smooths where there are any."""
    names = ["(Intercept)"] if formula.intercept else []
    parametric: list[str | Factor] = []
    for t in formula.parametric:
        if _is_factor(rows, t):
            f = Factor(t, rows.levels(t))
            parametric.append(f)
            names += [f"{t}[{v}]" for v in f.levels[1:]]
        else:
            parametric.append(t)
            names.append(t)
    made: list[tuple[SmoothSpec, Basis, object, bool]] = []
    for spec in formula.smooths:
        basis = make(spec, rows)
        if basis.width >= rows.n + 50_000:
            raise ValueError(f"{spec.label}: more basis functions than rows")
        if spec.by and _is_factor(rows, spec.by):
            made += [(spec, basis, level, False) for level in rows.levels(spec.by)]
        else:
            made.append((spec, basis, None, bool(spec.by)))
    unique = list({id(b): b for _, b, _, _ in made}.values())

    def profile(cols):
        counts = row_counts(cols)
        out = {"rows": np.array([counts.sum()])}
        for i, b in enumerate(unique):
            x = b.raw(cols)
            out[f"sum{i}"], out[f"max_{i}"] = counts @ x, np.array([np.abs(x).sum(1).max()])
        return out

    stats = rows.sweep(profile) if unique else {}
    smooths: list[BoundSmooth] = []
    start = len(names)
    for spec, basis, level, numeric in made:
        i = next(j for j, b in enumerate(unique) if b is basis)
        mean = stats[f"sum{i}"] / stats["rows"][0]
        shift = None
        if isinstance(basis, ShapeSpline):
            turn, shift = np.eye(basis.width), mean
            turn = np.eye(basis.sigma.shape[1])
        elif basis.constrain and not numeric and not spec.xt.get("random"):
            turn = null_basis(mean)
        else:
            turn = np.eye(basis.width)
        scale = float(stats[f"max_{i}"][0]) ** 2
        pens = []
        for s in basis.penalties:
            norm = np.abs(s).sum(0).max()
            if norm > 0:
                pens.append(turn.T @ (s * scale / norm) @ turn)
        label = spec.label if level is None else f"{spec.label}[{level}]"
        b = BoundSmooth(spec, basis, turn, label, level, numeric, shift, None, pens, start)
        start += b.width
        smooths.append(b)
    design = Design(formula, names, parametric, smooths, [], rows.n)
    if side and _nested(smooths):
        _side_constrain(design, rows)
    start = len(names)
    for b in smooths:
        b.start = start
        start += b.width
        names += [f"{b.label}.{i + 1}" for i in range(b.width)]
    design.penalties = _penalties(smooths)
    return design


def _nested(smooths: list[BoundSmooth]) -> bool:
    seen: list[set] = []
    for b in sorted(smooths, key=lambda b: len(b.spec.vars)):
        mine = set(b.spec.vars) | ({b.spec.by} if b.numeric_by else set())
        if any(mine & other and (mine <= other or other <= mine) for other in seen) and b.spec.kind != "ti":
            return True
        seen.append(mine)
    return False


def _side_constrain(design: Design, rows) -> None:
    """Drops columns of a smooth that smaller smooths of its variables already span, found by Cholesky steps on
    the Gram matrix: a column goes where what is left of it is nothing."""
    # one pass: the Gram matrix of the unpenalised rows
    g = rows.sweep(lambda cols: {"g": (x := design.matrix(cols)).T @ x})["g"]
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    g = g * scale[:, None] * scale
    for b in sorted(design.smooths, key=lambda b: len(b.spec.vars)):
        below = [s for s in design.smooths if s is not b and set(s.spec.vars) < set(b.spec.vars) and s.level is None]
        below += [s for s in design.smooths[: design.smooths.index(b)] if set(s.spec.vars) == set(b.spec.vars) and s.spec.by == b.spec.by and s.level == b.level]
        if not below or b.spec.kind == "ti":
            continue
        base = [i for s in below for i in range(s.start, s.start + s.turn.shape[1]) if s.keep is None or i - s.start in s.keep]
        base = (list(range(design.n_parametric)) + base) if base else base
        keep = []
        held = list(base)
        for j in range(b.turn.shape[1]):
            col = b.start + j
            left = g[col, col] - g[col, held] @ np.linalg.lstsq(g[np.ix_(held, held)], g[held, col], rcond=1e-11)[0]
            if left > 1e-7:
                keep.append(j)
                held.append(col)
        if len(keep) < b.turn.shape[1]:
            b.keep = np.array(keep, int)
            b.penalties = [s[np.ix_(keep, keep)] for s in b.penalties]


def _penalties(smooths: list[BoundSmooth]) -> list[Penalty]:
    out: list[Penalty] = []
    shared: dict[tuple, Penalty] = {}
    for b in smooths:
        if b.spec.fx:
            continue
        for j, s in enumerate(b.penalties):
            fixed = None
            if b.spec.sp is not None and j < len(b.spec.sp) and b.spec.sp[j] >= 0:
                fixed = float(b.spec.sp[j])
            key = (b.spec.id, j)
            if b.spec.id and key in shared:
                shared[key].blocks.append((b.slice, s))
                continue
            pen = Penalty([(b.slice, (s + s.T) / 2)], b.label if len(b.penalties) == 1 else f"{b.label}.{j + 1}", fixed)
            if b.spec.id:
                shared[key] = pen
            out.append(pen)
    for pen in out:
        pen.rank = sum(int(np.linalg.matrix_rank(s, tol=1e-9 * max(np.abs(s).max(), 1e-300), hermitian=True)) for _, s in pen.blocks)
    return out
