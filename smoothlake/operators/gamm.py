"""Additive mixed models: grouped random effects as ridge-penalised columns beside the smooths.

``(1 + x | g)`` gives one block of columns per term, a column per level, with a variance of its own per term;
nested groups ``(1 | a/b)`` get levels of the pair. Fits go through the same passes as ``gam``; for other than
Gaussian responses that is penalised quasi-likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smoothlake.operators.families import family_of
from smoothlake.operators.gam import GamControl, fit_design, prepare
from smoothlake.operators.model import GamModel
from smoothlake.plans.design import bind
from smoothlake.plans.formula import Formula, RandomSpec, SmoothSpec, parse
from smoothlake.sources.rows import rows_of


def group_column(groups: tuple[str, ...]) -> str:
    return groups[0] if len(groups) == 1 else "__" + "_".join(groups)


def random_smooths(specs: tuple[RandomSpec, ...]) -> list[SmoothSpec]:
    """A ridge smooth per term of each random effect; no sum-to-zero constraint, the ridge identifies them."""
    out = []
    for r in specs:
        g = group_column(r.group)
        for t in r.terms:
            out.append(SmoothSpec((g,), "re", by=None if t == "1" else t, xt={"random": r.label}))
    return out


@dataclass
class GammModel:
    """gam: the fitted model; random: the specifications, in the order of their terms."""

    gam: GamModel
    specs: tuple[RandomSpec, ...]
    formula: Formula

    def __getattr__(self, name):
        return getattr(self.__dict__["gam"], name)

    def _terms(self):
        random = [s for s in self.gam.design.smooths if s.spec.xt.get("random")]
        i = 0
        for r in self.specs:
            for t in r.terms:
                yield r, t, random[i]
                i += 1

    def ranef(self) -> DataFrame:
        """group, level, term, effect: the predicted random effects."""
        rows = [(":".join(r.group), str(level), "(Intercept)" if t == "1" else t, float(v)) for r, t, s in self._terms() for level, v in zip(s.basis.levels, s.turn @ self.gam.beta[s.slice], strict=True)]
        return self.gam.table.sparkSession.createDataFrame(rows, "group string, level string, term string, effect double")

    def varcorr(self) -> DataFrame:
        """group, label, variance, std, n_levels, n_terms, with the residual's row last."""
        rows = []
        for r, t, s in self._terms():
            j = next(i for i, p in enumerate(self.gam.design.penalties) if p.blocks[0][0] == s.slice)
            unit = self.gam.design.penalties[j].blocks[0][1]
            var = float(self.gam.scale / (np.exp(self.gam.log_sp[j]) * np.diag(unit).mean()))
            rows.append((":".join(r.group), "(Intercept)" if t == "1" else t, var, float(np.sqrt(var)), len(s.basis.levels), len(r.terms)))
        if not self.gam.family.known_scale:
            rows.append(("Residual", "", float(self.gam.scale), float(np.sqrt(self.gam.scale)), 0, 0))
        return self.gam.table.sparkSession.createDataFrame(rows, "group string, label string, variance double, std double, n_levels long, n_terms int")

    def predict(self, newdata: DataFrame | None = None, type: str = "response", se: bool = False) -> DataFrame:
        """Unseen levels have effect zero."""
        df = self.gam.table if newdata is None else with_groups(newdata, self.specs)
        return self.gam.predict(df, type, se)


def with_groups(df: DataFrame, specs: tuple[RandomSpec, ...]) -> DataFrame:
    for r in specs:
        if len(r.group) > 1 and group_column(r.group) not in df.columns:
            df = df.withColumn(group_column(r.group), F.concat_ws(":", *[F.col(g).cast("string") for g in r.group]))
    return df


def gamm(formula, df: DataFrame, family=None, link=None, method: str = "REML", weights=None, offset: str | None = None, control: GamControl = GamControl(), na_action: str = "fail", backend: str = "LAMS") -> GammModel:
    """backend LAMS and PQL are one method here: working linear mixed models until they settle."""
    if backend.upper() not in ("LAMS", "PQL"):
        raise ValueError("backend is LAMS or PQL")
    f = parse(formula)
    if not f.random:
        raise ValueError("a mixed model needs a random effect, (1 | group)")
    fam = family_of(family, link)
    wide = with_groups(df, f.random)
    full = replace(f, smooths=(*f.smooths, *random_smooths(f.random)), random=())
    narrow, n, ranges = prepare(wide, full, weights, offset, na_action)
    problem = fam.valid(*ranges[f.response])
    if problem:
        raise ValueError(problem)
    rows = rows_of(narrow, n, control.local_rows)
    design = bind(full, rows, side=False)
    return GammModel(fit_design(design, rows, narrow, fam, method, control, n), f.random, f)

