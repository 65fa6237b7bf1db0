"""Smooths as random effects: the transform between penalised and mixed-model form, on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from smoothlake.operators.rowmap import add_columns
from smoothlake.plans.design import BoundSmooth, Design, bind
from smoothlake.plans.formula import Formula, SmoothSpec, parse
from smoothlake.sources.rows import rows_of, validate


@dataclass
class SmoothMixed:
    """columns @ fixed are the unpenalised ones, columns @ random[i] those with independent effects of variance i."""

    smooth: BoundSmooth
    fixed: np.ndarray
    random: list[np.ndarray]

    def design(self, cols) -> tuple[np.ndarray, list[np.ndarray]]:
        x = self.smooth.columns(cols)
        return x @ self.fixed, [x @ r for r in self.random]

    def back(self, b_fixed: np.ndarray, b_random: list[np.ndarray]) -> np.ndarray:
        """Coefficients of the smooth from those of the mixed form."""
        return self.fixed @ b_fixed + sum(r @ b for r, b in zip(self.random, b_random, strict=True))


def smooth2random(s: BoundSmooth) -> SmoothMixed:
    """Splits the columns by penalty, each block whitened so that its penalty is the identity. Several penalties are
    split one after the other: of what the earlier ones leave unpenalised, the next takes its range; penalties that
    overlap share the first one's variance there."""
    rest = np.eye(s.width)
    random = []
    for p in s.penalties:
        m = rest.T @ p @ rest
        if not m.size:
            break
        value, vector = np.linalg.eigh((m + m.T) / 2)
        on = value > 1e-9 * max(value.max(initial=0), 1e-300)
        if on.any() and value.max() > 1e-12:
            random.append(rest @ vector[:, on] / np.sqrt(value[on]))
            rest = rest @ vector[:, ~on]
    return SmoothMixed(s, rest, random)


def gam_matrices(formula: str | Formula, df: DataFrame) -> tuple[Design, list[SmoothMixed]]:
    """The bound design of a formula and the mixed form of each smooth."""
    f = parse(formula)
    factors = {s.vars[0] for s in f.smooths if s.bs in ("re", "mrf")} | {c for c, t in df.dtypes if t == "string"}
    columns = [c for c in f.columns]
    narrow, n, _ = validate(df, columns, [c for c in columns if c not in factors])
    design = bind(f, rows_of(narrow, n))
    return design, [smooth2random(s) for s in design.smooths]


def gam_smooth(df: DataFrame, spec: SmoothSpec, response: str | None = None) -> SmoothMixed:
    """One smooth in mixed form."""
    return gam_matrices(Formula(response or spec.vars[0], (), True, (spec,)), df)[1][0]


def s2r_predict(m: SmoothMixed, df: DataFrame) -> DataFrame:
    """The table with arrays ``Xf`` and ``Zr``: the mixed-form columns of its rows."""
    needed = [*m.smooth.spec.vars, *([m.smooth.spec.by] if m.smooth.spec.by else [])]

    def block(cols):
        x, z = m.design(cols)
        return {"Xf[]": x, "Zr[]": np.hstack(z) if z else np.zeros((len(x), 0))}

    return add_columns(df, needed, block, ["Xf[]", "Zr[]"], None)
