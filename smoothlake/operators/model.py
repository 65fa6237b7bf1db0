"""A fitted additive model: small matrices on the driver, questions about rows answered as DataFrames."""

from __future__ import annotations

import json
import pickle
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from smoothlake.functions.special import chi2_sf, f_sf, normal_cdf, normal_ppf, t_ppf, t_sf2
from smoothlake.operators.families import Family
from smoothlake.operators.rowmap import add_columns
from smoothlake.plans.design import Design


SAVED = "description string, state binary"


def load(spark: SparkSession, path: str) -> GamModel:
    """A model that ``save`` wrote. It predicts for new rows; what needs the rows of the fit is not there. Like any pickled
    state, read it from places you trust only."""
    rows = spark.read.schema(SAVED).parquet(path).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} holds {len(rows)} models")
    return pickle.loads(bytes(rows[0].state))


@dataclass
class GamModel:
    design: Design
    family: Family
    method: str
    beta: np.ndarray
    log_sp: np.ndarray
    vp: np.ndarray  # posterior covariance
    ve: np.ndarray  # sampling covariance
    edf: np.ndarray  # per coefficient
    edf2: np.ndarray
    scale: float
    deviance: float
    null_deviance: float
    pearson: float
    n: int
    sum_weights: float
    criterion: float
    gram: np.ndarray
    rhs: np.ndarray
    zz: float
    passes: int
    converged: bool
    table: DataFrame | None = field(default=None, repr=False)
    rows: Any = field(default=None, repr=False)
    log_likelihood: float | None = None
    likelihood: Any = field(default=None, repr=False)  # the function that reckons it
    raw_beta: np.ndarray | None = None  # of shape-constrained models, before the exponential

    # -- plain accessors -------------------------------------------------------------------------------
    def coef(self) -> np.ndarray:
        return self.beta

    def coefnames(self) -> list[str]:
        return list(self.design.names)

    def vcov(self, freq: bool = False) -> np.ndarray:
        return self.ve if freq else self.vp

    def stderror(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.vp), 0))

    def nobs(self) -> int:
        return self.n

    def nulldeviance(self) -> float:
        return self.null_deviance

    def model_edf(self) -> float:
        return float(self.edf.sum())

    def smooth_edf(self) -> dict[str, float]:
        return {s.label: float(self.edf[s.slice].sum()) for s in self.design.smooths}

    def sp(self) -> dict[str, float]:
        return {p.label: float(np.exp(r)) for p, r in zip(self.design.penalties, self.log_sp, strict=True)}

    def dof(self) -> float:
        return self.model_edf() + (not self.family.known_scale) + len(self.family.extra())

    def dof_residual(self) -> float:
        return self.n - self.model_edf()

    def loglikelihood(self) -> float:
        """Of the rows; reckoned when first asked for, which may take a pass."""
        if self.log_likelihood is None:
            if self.likelihood is None or self.rows is None:
                raise ValueError("this model has no likelihood, or was taken from its rows before it was asked for")
            self.log_likelihood = self.likelihood(self)
        return self.log_likelihood

    def aic(self) -> float:
        return -2 * self.loglikelihood() + 2 * self.dof()

    def aicc(self) -> float:
        k = self.dof()
        return self.aic() + 2 * k * (k + 1) / max(self.n - k - 1, 1e-9)

    def bic(self) -> float:
        return -2 * self.loglikelihood() + np.log(self.n) * self.dof()

    def deviance_explained(self) -> float:
        return 1 - self.deviance / self.null_deviance if self.null_deviance else 0.0

    def r2(self) -> float:
        return self.deviance_explained()

    def adjr2(self) -> float:
        return 1 - (self.deviance / max(self.dof_residual(), 1e-9)) / (self.null_deviance / max(self.n - 1, 1))

    def confint(self, level: float = 0.95) -> np.ndarray:
        q = float(normal_ppf((1 + level) / 2)) if self.family.known_scale else t_ppf((1 + level) / 2, self.dof_residual())
        se = self.stderror()
        return np.column_stack([self.beta - q * se, self.beta + q * se])

    # -- tables of a few rows ----------------------------------------------------------------------------
    def _spark(self) -> SparkSession:
        return self.table.sparkSession if self.table is not None else SparkSession.getActiveSession()

    def coeftable(self) -> DataFrame:
        """term, estimate, std_error, statistic, p_value of the parametric part."""
        out = []
        for i in range(self.design.n_parametric):
            se = float(np.sqrt(max(self.ve[i, i], 0))) or float("nan")
            t = float(self.beta[i]) / se
            p = float(2 * (1 - normal_cdf(abs(t)))) if self.family.known_scale else t_sf2(abs(t), max(self.dof_residual(), 1.0))
            out.append((self.design.names[i], float(self.beta[i]), se, t, p))
        return self._spark().createDataFrame(out, "term string, estimate double, std_error double, statistic double, p_value double")

    def smooth_tests(self) -> list[tuple[str, float, float, float, float]]:
        """Wald tests of each smooth: (label, edf, reference df, statistic, p)."""
        out = []
        for s in self.design.smooths:
            at = s.slice
            edf = float(self.edf[at].sum())
            ref = float(min(max(self.edf2[at].sum(), edf, 1e-3), s.width))
            v = self.vp[at, at]
            value, vector = np.linalg.eigh((v + v.T) / 2)
            value, vector = value[::-1], vector[:, ::-1]
            r = int(np.clip(round(ref), 1, int((value > value[0] * 1e-9).sum()) or 1))
            u = vector[:, :r].T @ self.beta[at]
            wald = float((u * u / value[:r]).sum())
            if self.family.known_scale:
                out.append((s.label, edf, ref, wald, chi2_sf(wald, r)))
            else:
                out.append((s.label, edf, ref, wald / r, f_sf(wald / r, r, max(self.dof_residual(), 1.0))))
        return out

    def summary(self) -> str:
        lines = [f"Family: {self.family.name}, link {self.family.link_name}", f"n = {self.n}, {self.method} = {self.criterion:.5g}, scale = {self.scale:.5g}, deviance explained {100 * self.deviance_explained():.1f} %", "", "term | estimate | std. error"]
        se = np.sqrt(np.maximum(np.diag(self.ve), 0))
        lines += [f"{self.design.names[i]} | {self.beta[i]:.5g} | {se[i]:.4g}" for i in range(self.design.n_parametric)]
        lines += ["", "smooth | edf | ref. df | statistic | p"]
        lines += [f"{a} | {b:.3f} | {c:.3f} | {d:.3f} | {e:.3g}" for a, b, c, d, e in self.smooth_tests()]
        return "\n".join(lines)

    __str__ = summary

    # -- rows ----------------------------------------------------------------------------------------------
    def needed(self) -> list[str]:
        return [c for c in self.design.formula.columns if c != self.design.formula.response or any(c in s.spec.vars for s in self.design.smooths)]

    def _numeric(self) -> set[str]:
        factors = {v for s in self.design.smooths for v in ([s.basis.factor] if hasattr(s.basis, "factor") else s.spec.vars[:1] if s.basis.discrete else [])}
        factors |= {s.spec.by for s in self.design.smooths if s.level is not None}
        factors |= {t.name for t in self.design.parametric if not isinstance(t, str)}
        return set(self.design.formula.columns) - factors

    def predict(self, newdata: DataFrame | None = None, type: str = "response", se: bool = False, offset: str | None = None) -> DataFrame:
        """The table with ``fit`` (and ``se_fit``): on the link or the response scale; type='terms' adds an array
        of the smooths' contributions."""
        df = self.table if newdata is None else newdata
        design, beta, family, vp = self.design, self.beta, self.family, self.vp
        if type not in ("link", "response", "terms", "lpmatrix"):
            raise ValueError("type is link, response, terms or lpmatrix")
        needed = self.needed() + ([offset] if offset else [])
        names = {"terms": ["terms[]"], "lpmatrix": ["lpmatrix[]"]}.get(type, ["fit"] + ["se_fit"] * se)

        def block(cols):
            x = design.matrix(cols)
            if type == "lpmatrix":
                return {"lpmatrix[]": x}
            if type == "terms":
                return {"terms[]": np.column_stack([x[:, s.slice] @ beta[s.slice] for s in design.smooths])}
            eta = x @ beta + (cols[offset] if offset else 0.0)
            out = {"fit": eta}
            if se:
                out["se_fit"] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, vp, x), 0))
            if type == "response":
                out["fit"] = family.link.inv(eta)
                if se:
                    out["se_fit"] = out["se_fit"] * np.abs(family.link.d1(eta))
            return out

        return add_columns(df, needed, block, names, self._numeric())

    def fitted(self) -> DataFrame:
        return self.predict()

    def residuals(self, type: str = "deviance", newdata: DataFrame | None = None) -> DataFrame:
        """The table with ``resid``: deviance, pearson, working or response."""
        if type not in ("deviance", "pearson", "working", "response"):
            raise ValueError("type is deviance, pearson, working or response")
        df = self.table if newdata is None else newdata
        design, beta, family = self.design, self.beta, self.family
        response = design.formula.response
        weight = "__w" if "__w" in df.columns else None
        off = "__offset" if "__offset" in df.columns else None
        needed = list(dict.fromkeys([*self.needed(), response, *([weight] if weight else []), *([off] if off else [])]))

        def block(cols):
            y = cols[response]
            w = cols[weight] if weight else np.ones(len(y))
            eta = design.matrix(cols) @ beta + (cols[off] if off else 0.0)
            mu = family.clip(family.link.inv(eta))
            r = {
                "response": lambda: y - mu,
                "pearson": lambda: (y - mu) * np.sqrt(w / family.variance(mu)),
                "working": lambda: (y - mu) / family.link.d1(eta),
                "deviance": lambda: np.sign(y - mu) * np.sqrt(np.maximum(family.deviance(y, mu, w), 0)),
            }[type]()
            return {"resid": r}

        return add_columns(df, needed, block, ["resid"], self._numeric() | {response})

    def leverage(self, newdata: DataFrame | None = None) -> DataFrame:
        """The table with ``hat``, the diagonal of the influence matrix."""
        df = self.table if newdata is None else newdata
        design, beta, family, v = self.design, self.beta, self.family, self.vp / self.scale
        weight = "__w" if "__w" in df.columns else None

        def block(cols):
            x = design.matrix(cols)
            eta = x @ beta
            mu = family.clip(family.link.inv(eta))
            w = (cols[weight] if weight else 1.0) * family.link.d1(eta) ** 2 / family.variance(mu)
            return {"hat": w * np.einsum("ij,jk,ik->i", x, v, x)}

        return add_columns(df, self.needed() + ([weight] if weight else []), block, ["hat"], self._numeric())

    def to_json(self) -> str:
        """What is known of the fit, as text; the model object itself can be pickled with ``state()``."""
        return json.dumps({"formula": repr(self.design.formula), "family": self.family.name, "link": self.family.link_name, "names": self.design.names, "beta": self.beta.tolist(), "log_sp": self.log_sp.tolist(), "scale": self.scale, "deviance": self.deviance, "edf": self.edf.tolist(), "n": self.n})

    def save(self, path: str) -> None:
        """The model as a table of one row in any store that Spark writes: what ``to_json`` says, and its whole state."""
        row = (self.to_json(), pickle.dumps(self.state()))
        self._spark().createDataFrame([row], SAVED).coalesce(1).write.parquet(path)

    def state(self) -> GamModel:
        """A copy without handles to a session, for pickling."""
        from dataclasses import replace

        if self.likelihood is not None and self.rows is not None:
            self.loglikelihood()
        return replace(self, table=None, rows=None, likelihood=None)

    def close(self) -> None:
        """Frees the rows that the cluster holds for this model; what needs them again fails from then on."""
        if self.rows is not None:
            self.rows.close()
            self.rows = None
