"""Fitting additive models: ``gam`` and ``bam``.

One pass gives the Gram matrix of the working linear model at the current coefficients, with deviance and
dispersion; smoothing parameters and coefficients follow on the driver. A Gaussian model takes one such pass,
whatever the number of outer steps; others one per iteration.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smoothlake.operators.families import Beta, Family, NegativeBinomial, Tweedie, family_of
from smoothlake.operators.model import GamModel
from smoothlake.operators.smoothing import Selector, Working, inverse
from smoothlake.plans.design import Design, bind
from smoothlake.plans.formula import Formula, parse
from smoothlake.sources.rows import LOCAL, LocalRows, SparkRows, rows_of, validate

#: Bases whose coefficients are exponentials.
SHAPES = ("mpi", "mpd", "cv", "cx", "micx", "micv", "mdcx", "mdcv")
WEIGHT, OFFSET, WITHIN, COUNT = "__w", "__offset", "__within", "__rows"


@dataclass(frozen=True)
class GamControl:
    """epsilon: relative change of the penalised deviance at which iterations end. max_iterations: passes.
    gamma: factor of the freedom in the criteria. local_rows: counted rows the driver may hold."""

    epsilon: float = 1e-7
    max_iterations: int = 60
    gamma: float = 1.0
    local_rows: int = LOCAL


def gam_control(**options) -> GamControl:
    return GamControl(**options)


@dataclass(frozen=True)
class BamControl:
    """discrete: compress rows with equal (binned) covariates. max_unique: bins of a covariate with more distinct
    values; None keeps them all apart."""

    discrete: bool = True
    max_unique: int | None = None


def bam_control(**options) -> BamControl:
    return BamControl(**options)


def prepare(df: DataFrame, formula: Formula, weights: str | None, offset: str | None, na_action: str, more: list[str] = ()) -> tuple[DataFrame, int, dict]:
    """The model's columns, checked in one job."""
    columns = list(dict.fromkeys([*formula.columns, *([weights] if weights else []), *([offset] if offset else []), *more]))
    kinds = dict(df.dtypes)
    factors = {c for c in columns if kinds.get(c) in ("string", "boolean")}
    for spec in formula.smooths:
        if spec.bs in ("re", "mrf", "fs", "sz"):
            factors |= set(spec.vars[:1] if spec.bs in ("re", "mrf") else [v for v in spec.vars if kinds.get(v) == "string"])
    for r in formula.random:
        factors |= set(r.group)
    if formula.response in factors:
        raise TypeError(f"the response {formula.response} must be numeric")
    for spec in formula.smooths:
        for v in spec.vars:
            if v in factors and spec.bs not in ("re", "mrf", "fs", "sz"):
                raise TypeError(f"{spec.label}: {v} must be numeric")
    narrow, n, ranges = validate(df, columns, [c for c in columns if c not in factors], na_action)
    if weights and ranges[weights][0] < 0:
        raise ValueError("weights are not negative")
    out = narrow.withColumn(WEIGHT, F.col(f"`{weights}`").cast("double") if weights else F.lit(1.0))
    return out.withColumn(OFFSET, F.col(f"`{offset}`").cast("double") if offset else F.lit(0.0)), n, ranges


def compress(df: DataFrame, formula: Formula, family: Family, control: BamControl, weights: str | None) -> DataFrame:
    """Rows with equal covariates as one row: total weight, mean response, and the spread within. For a fixed
    linear predictor the Gram matrix, the score and, but for a constant, the deviance depend on these alone."""
    y, w = F.col(f"`{formula.response}`").cast("double"), F.col(WEIGHT)
    keys = [c for c in formula.columns if c != formula.response]
    if control.max_unique:
        for c in keys:
            if dict(df.dtypes)[c] == "double":
                lo, hi = df.agg(F.min(c), F.max(c)).first()
                if hi > lo and df.select(c).distinct().count() > control.max_unique:
                    step = (hi - lo) / control.max_unique
                    bin_ = F.least(F.floor((F.col(c) - lo) / step), F.lit(control.max_unique - 1))
                    df = df.withColumn(c, F.lit(lo) + (bin_ + 0.5) * step)
    grouped = df.groupBy(*[F.col(f"`{c}`") for c in keys], OFFSET).agg(
        F.sum(w).alias(WEIGHT), (F.sum(w * y) / F.sum(w)).alias(formula.response), F.sum(w * y * y).alias("__yy"), F.sum(w * _saturated(family, y)).alias("__s"), F.count(F.lit(1)).alias(COUNT)
    )
    mean = F.col(f"`{formula.response}`")
    spread = F.greatest(F.col("__yy") - F.col(WEIGHT) * mean * mean, F.lit(0.0))
    return grouped.withColumn("__spread", spread).withColumn(WITHIN, 2 * (F.col("__s") - F.col(WEIGHT) * _saturated(family, mean))).drop("__yy", "__s")


def _saturated(family: Family, y):
    log = lambda c: F.when(c > 0, c * F.log(c)).otherwise(0.0)
    name = family.name.removeprefix("quasi")
    return {"normal": lambda: 0.5 * y * y, "poisson": lambda: log(y) - y, "binomial": lambda: log(y) + log(1 - y), "gamma": lambda: -F.log(y) - 1, "inverse_gaussian": lambda: 0.5 / y}[name]()


def working_pass(design: Design, family: Family, response: str, beta: np.ndarray | None):
    """The function of one pass: Gram matrix and right side of the working model at ``beta``."""
    link = family.link

    def block(cols):
        x = design.matrix(cols)
        y, w = np.asarray(cols[response], float), np.asarray(cols[WEIGHT], float)
        offset = np.asarray(cols[OFFSET], float)
        if beta is None:
            mu = family.clip(family.start(y, w))
            eta = link.g(mu)
        else:
            eta = x @ beta + offset
            mu = family.clip(link.inv(eta))
        d = link.d1(eta)
        d = np.where(np.abs(d) < 1e-12, 1e-12, d)
        if hasattr(family, "working"):
            score, info = family.working(y, mu, w)
            ww = np.clip(info * d * d, 1e-12, 1e12)
            z = eta - offset + score * d / ww
        else:
            ww = np.where(w > 0, np.clip(w * d * d / np.maximum(family.variance(mu), 1e-300), 1e-12, 1e12), 0.0)
            z = eta - offset + (y - mu) / d
        v = np.maximum(family.variance(mu), 1e-300)
        dev = family.deviance(y, mu, w)
        pearson = w * (y - mu) ** 2 / v
        square = ww @ (z * z)
        if WITHIN in cols:  # what compressed rows differ by within their group
            within = cols["__spread"] / v
            dev, pearson, square = dev + cols[WITHIN], pearson + within, square + within.sum()
        xw = x * ww[:, None]
        out = {"g": x.T @ xw, "b": xw.T @ z, "s": np.array([square, dev.sum(), pearson.sum(), w.sum(), (w * y).sum(), (cols[COUNT] if COUNT in cols else w > 0).sum(), ww.sum()])}
        if getattr(family, "estimate", False) and hasattr(family, "theta_derivatives") and beta is not None:
            g, h = family.theta_derivatives(y, mu, w)
            out["theta"] = np.array([g.sum(), h.sum()])
        return out

    return block


def gam(formula: str | Formula, df: DataFrame, family=None, link: str | None = None, method: str = "REML", weights: str | None = None, offset: str | None = None, control: GamControl = GamControl(), na_action: str = "fail", optimizer: str = "efs", discrete: BamControl | None = None, start=None, **more):
    """Fits an additive model. Multi-parameter families, shape constraints, linear constraints, random effects
    and priors go to their own fitters. optimizer: ``efs`` (iterated working models) or ``general`` (Newton's method on
    the likelihood, smoothing by its Laplace approximation). start: coefficients to begin with."""
    from smoothlake.operators.gamlss import gamlss
    from smoothlake.operators.multifamilies import MultiFamily

    if optimizer not in ("efs", "general"):
        raise ValueError(f"optimizer is efs or general, not {optimizer}")
    if isinstance(family, MultiFamily):
        if optimizer != "efs" or start is not None:
            raise ValueError("families with several parameters take the optimizer efs and no start")
        if (priors := more.pop("priors", None)) is not None:
            return _bayes(formula, df, family, priors, weights, offset, control, na_action, more)
        return gamlss(formula, df, family, weights=weights, offset=offset, control=control, na_action=na_action, **more)
    if isinstance(formula, (list, tuple)):
        raise ValueError("several formulas need a family with several parameters")
    f = parse(formula)
    fam = family_of(family, link)
    if more.get("priors") is not None and (f.random or any(s.bs in SHAPES for s in f.smooths)):
        return _bayes(f, df, fam, more.pop("priors"), weights, offset, control, na_action, more)
    if more.get("priors") is not None:
        from smoothlake.operators.bayes import bayes_gam

        return bayes_gam(f, df, fam, priors=more.pop("priors"), weights=weights, offset=offset, control=control, na_action=na_action, **more)
    more.pop("priors", None)
    if more:
        raise TypeError(f"unknown arguments: {sorted(more)}")
    if f.random:
        from smoothlake.operators.gamm import gamm

        if optimizer == "general" or start is not None:
            raise ValueError("models with random effects take the optimizer efs and no start")
        return gamm(f, df, fam, method=method, weights=weights, offset=offset, control=control, na_action=na_action)
    narrow, n, ranges = prepare(df, f, weights, offset, na_action, _extra_columns(f))
    problem = fam.valid(*ranges[f.response])
    if problem:
        raise ValueError(f"{problem}; {f.response} ranges over {ranges[f.response]}")
    rows = _rows(narrow, n, f, fam, control, discrete, weights)
    design = bind(f, rows)
    design.n = n
    if design.positive().any() or design.inequalities() is not None or design.equalities() is not None:
        from smoothlake.operators.scam import fit_constrained

        if optimizer == "general" or start is not None:
            raise ValueError("constrained models take the optimizer efs and no start")
        return fit_constrained(design, rows, narrow, fam, method, control, n)
    if start is not None and len(start) != design.p:
        raise ValueError(f"start has {len(start)} coefficients, the model {design.p}")
    if optimizer == "general":
        from smoothlake.operators.general import fit_general

        if method.upper() != "REML":
            raise ValueError(f"the general optimizer takes REML, not {method}")
        return fit_general(design, rows, narrow, fam, control, n, start)
    return fit_design(design, rows, narrow, fam, method, control, n, start)


def _bayes(formula, df, family, priors, weights, offset, control, na_action, more):
    from smoothlake.operators.bayes import PriorSpec
    from smoothlake.operators.bayes_hmc import bayes

    if offset is not None:
        raise ValueError("these models are sampled without offsets")
    return bayes(formula, df, family, PriorSpec() if priors is True else priors, weights=weights, na_action=na_action, gam_control=control, **more)


def _extra_columns(f: Formula) -> list[str]:
    return [s.xt["y"] for s in f.smooths if s.bs == "fp" and s.xt.get("y")]


def _rows(narrow: DataFrame, n: int, f: Formula, fam: Family, control: GamControl, discrete: BamControl | None, weights):
    if n <= control.local_rows and discrete is None:
        return rows_of(narrow, n, control.local_rows)
    if fam.exponential and (discrete is None or discrete.discrete) and not _extra_columns(f):
        from pyspark import StorageLevel

        small = compress(narrow, f, fam, discrete or BamControl(), weights).persist(StorageLevel.MEMORY_AND_DISK)
        groups = small.count()
        if groups > control.local_rows and groups < n / 4:
            return SparkRows(small, groups, (small,))
        kept = rows_of(small, groups, control.local_rows) if groups <= control.local_rows else None
        small.unpersist()
        if kept is not None:
            return kept
    return rows_of(narrow, n, control.local_rows)


def bam(formula, df: DataFrame, family=None, link=None, method: str = "REML", weights=None, offset=None, control: GamControl = GamControl(), bam_ctrl: BamControl = BamControl(), na_action: str = "fail") -> GamModel:
    """The same model with rows of equal covariates compressed first; exponential families only."""
    if not family_of(family, link).exponential:
        raise ValueError("bam takes exponential families only")
    return gam(formula, df, family, link, method, weights, offset, control, na_action, discrete=bam_ctrl)


def fit_design(design: Design, rows: LocalRows | SparkRows, table: DataFrame, family: Family, method: str, control: GamControl, n: int, start=None) -> GamModel:
    selector = Selector(design, method, control.gamma)
    response = design.formula.response
    family = replace(family)
    direct = family.name == "normal" and family.link_name == "identity"
    rho, beta = None, None if start is None or direct else np.asarray(start, float)
    passes, halvings, moved = 0, 0, 0.0
    previous, last = None, None  # coefficients and deviance before the last step
    stats = None
    converged = direct
    while passes < control.max_iterations:
        r = rows.sweep(working_pass(design, family, response, beta))
        passes += 1
        zz, dev, pearson, total_w, wy, n_used, _ = r["s"]
        if rho is not None:
            s = selector.penalty(rho)
            pdev = dev + beta @ s @ beta
            # the step is judged under the smoothing parameters it was made with
            before = None if last is None or previous is None else last + previous @ s @ previous
            if before is not None and (not np.isfinite(pdev) or pdev > before + 1e-7 * (abs(before) + 0.1)) and halvings < 10 and moved < 1e-3:
                beta, halvings = (beta + previous) / 2, halvings + 1
                continue
            settled = before is not None and halvings == 0 and abs(before - pdev) < control.epsilon * (abs(pdev) + 0.1)
            stats, halvings = r, 0
            if settled and moved < 1e-3 and passes > 2:
                converged = True
                break
            last = dev
        known = 1.0 if family.known_scale else None
        w = Working(r["g"], r["b"], zz, n_used, known)
        if "theta" in r:
            g, h = r["theta"]
            step = float(np.clip(g / abs(h) if h else 0.0, -1.5, 1.5))
            name = "theta" if isinstance(family, NegativeBinomial) else "phi"
            old = getattr(family, name)
            value = float(np.clip(old * np.exp(step), 1e-4, 1e6))
            moved = abs(np.log(value / old))
            family = replace(family, **{name: value})
        if isinstance(family, Tweedie) and family.estimate and beta is not None and passes in (4, 7, 10):
            family = _choose_power(rows, design, family, response, beta, pearson / max(n_used - design.p / 2, 1))
            last = None
        rho = selector.select(w, rho, newton=25 if direct or passes > 3 else 3)
        previous, beta = beta, inverse(w.g + selector.penalty(rho)) @ w.b
        if direct:
            stats = r
            break
    return _finish(design, rows, table, family, selector, rho, beta, stats, w, n, passes, converged, direct)


def _choose_power(rows, design, family: Tweedie, response, beta, scale) -> Tweedie:
    """The power with the largest likelihood: a grid of nine in a pass, refined twice."""
    lo, hi = 1.05, 1.95
    for _ in range(3):
        grid = np.linspace(lo, hi, 9)

        def block(cols):
            x = design.matrix(cols)
            y, w = np.asarray(cols[response], float), np.asarray(cols[WEIGHT], float)
            mu = family.clip(family.link.inv(x @ beta + cols[OFFSET]))
            out = []
            for p in grid:
                # the dispersion that fits the same squared errors under this power
                out.append([family.loglik(y, mu, w, scale * np.mean(mu ** (family.p - p)), p).sum()])
            return {"ll": np.array(out)}

        ll = rows.sweep(block)["ll"][:, 0]
        i = int(np.argmax(ll))
        lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, 8)]
    return replace(family, p=float(grid[i]))


def _finish(design, rows, table, family, selector, rho, beta, stats, w, n, passes, converged, direct) -> GamModel:
    s = selector.penalty(rho)
    inv = inverse(w.g + s)
    zz, dev, pearson, total_w, wy, n_used, _ = stats["s"]
    f = inv @ w.g
    edf = np.diag(f).copy()
    if direct:
        dev = pearson = float(max(w.zz - 2 * beta @ w.b + beta @ w.g @ beta, 0.0))
    scale = 1.0 if family.known_scale else float(pearson / max(n_used - edf.sum(), 1e-6))
    mean = wy / total_w
    null = _null_deviance(rows, family, design.formula.response, mean)
    m = GamModel(
        design=design, family=family, method=selector.method, beta=beta, log_sp=rho, vp=inv * scale, ve=f @ inv * scale, edf=edf,
        edf2=2 * edf - np.einsum("ij,ji->i", f, f), scale=scale, deviance=float(dev), null_deviance=null, pearson=float(pearson), n=int(n), sum_weights=float(total_w),
        criterion=float(selector.score(rho, replace(w, scale=1.0 if family.known_scale else None))), gram=w.g, rhs=w.b, zz=float(w.zz), passes=passes, converged=converged, table=table, rows=rows,
    )
    m.likelihood = log_likelihood
    return m


def _null_deviance(rows, family, response, mean) -> float:
    def block(cols):
        y, w = np.asarray(cols[response], float), np.asarray(cols[WEIGHT], float)
        d = family.deviance(y, family.clip(np.full(len(y), mean)), w).sum()
        return {"d": np.array([d + (cols[WITHIN].sum() if WITHIN in cols else 0.0)])}

    return float(rows.sweep(block)["d"][0])


def is_compressed(rows) -> bool:
    return WITHIN in (rows.df.columns if isinstance(rows, SparkRows) else rows.columns)


def log_likelihood(m: GamModel) -> float:
    """Of all rows, by one rule however many they are and whether or not they were compressed.

    Exponential families: that of the saturated model, which needs responses and weights alone, less half the
    scaled deviance. Others: row by row. The Gaussian takes the scale that maximises it and, as is usual for
    weighted fits, no term for the weights; quasi-likelihoods are those of their parent family."""
    family, design, beta, dispersion = m.family, m.design, m.beta, m.scale
    response = design.formula.response
    if family.name == "normal":
        scale = m.deviance / m.n
        return float(-0.5 * m.n * (np.log(2 * np.pi * scale) + 1)) if scale > 0 else float("inf")
    if family.exponential:
        scale = 1.0 if family.name.removeprefix("quasi") in ("poisson", "binomial") else m.scale

        def saturated(cols):
            y, w = np.asarray(cols[response], float), np.asarray(cols[WEIGHT], float)
            y, w = y[w > 0], w[w > 0]
            return {"l": np.array([family.loglik(y, y, w, scale).sum()])}

        rows = SparkRows(m.table.select(f"`{response}`", WEIGHT), m.n) if is_compressed(m.rows) else m.rows
        return float(rows.sweep(saturated)["l"][0]) - m.deviance / (2 * scale)

    def each(cols):
        y, w = np.asarray(cols[response], float), np.asarray(cols[WEIGHT], float)
        mu = family.clip(family.link.inv(design.matrix(cols) @ beta + cols[OFFSET]))
        return {"l": np.array([family.loglik(y, mu, np.maximum(w, 1e-300), dispersion)[w > 0].sum()])}

    return float(m.rows.sweep(each)["l"][0])


__all__ = ["Beta", "BamControl", "GamControl", "bam", "bam_control", "gam", "gam_control"]
