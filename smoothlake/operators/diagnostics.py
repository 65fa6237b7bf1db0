"""Questions about fitted models: checks, tests, estimates on grids, derivatives, draws."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from smoothlake.functions.special import chi2_sf, f_sf, normal_cdf, normal_ppf
from smoothlake.operators.model import GamModel
from smoothlake.operators.rowmap import add_columns
from smoothlake.sources.rows import row_counts


def _frame(m: GamModel, rows, schema) -> DataFrame:
    return m._spark().createDataFrame(rows, schema)


def overview(m: GamModel) -> DataFrame:
    """label, type, dim, k, edf, ratio of each smooth."""
    rows = [(s.label, s.spec.kind if s.spec.kind != "s" else str(s.spec.bs), len(s.spec.vars), int(s.basis.width), float(m.edf[s.slice].sum()), float(m.edf[s.slice].sum()) / s.width) for s in m.design.smooths]
    return _frame(m, rows, "label string, type string, dim int, k int, edf double, ratio double")


def k_check(m: GamModel, blocks: int = 100, reps: int = 200, seed: int = 1) -> DataFrame:
    """label, k, edf, ratio, k_index, p_value: whether residuals of rows that are neighbours in a covariate are
    alike. Residuals are averaged in ``blocks`` equal ranges of the covariate; the index compares half the mean
    squared difference of neighbouring means, in units of their own noise, with one."""
    resid = m.residuals("deviance")
    rng = np.random.default_rng(seed)
    out = []
    for s in m.design.smooths:
        edf = float(m.edf[s.slice].sum())
        index = p = None
        v = s.spec.vars[0]
        if len(s.spec.vars) == 1 and dict(resid.dtypes)[v] == "double":
            lo, hi = resid.agg(F.min(v), F.max(v)).first()
            step = (hi - lo) / blocks or 1.0
            t = resid.groupBy(F.least(F.floor((F.col(v) - lo) / step), F.lit(blocks - 1)).alias("b")).agg(F.avg("resid").alias("r"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()
            z = np.array([r.r * math.sqrt(r.n) for r in t])
            if len(z) > 4:
                value = float(np.mean(np.diff(z) ** 2) / 2 / max(np.var(z), 1e-300))
                null = [np.mean(np.diff(rng.permutation(z)) ** 2) / 2 / max(np.var(z), 1e-300) for _ in range(reps)]
                index, p = value, float(np.mean(np.array(null) <= value))
        out.append((s.label, int(s.width), edf, edf / s.width, index, p))
    return _frame(m, out, "label string, k int, edf double, ratio double, k_index double, p_value double")


def gam_check(m: GamModel) -> str:
    lines = [f"Method: {m.method}; passes: {m.passes}; converged: {m.converged}", f"Deviance explained: {m.deviance_explained():.4f}; adjusted R2: {m.adjr2():.4f}", "smooth | k' | edf | edf / k'"]
    lines += [f"{s.label} | {s.width} | {m.edf[s.slice].sum():.3f} | {m.edf[s.slice].sum() / s.width:.3f}" for s in m.design.smooths]
    return "\n".join(lines)


def concurvity(m: GamModel, full: bool = True):
    """How well each term's columns are spanned by the others': {label: value}, or pairwise {(a, b): value} where
    not full. One pass gives the unweighted Gram matrix; the rest is algebra."""
    design = m.design
    g = m.rows.sweep(lambda cols: {"g": (x := design.matrix(cols)).T @ (x * row_counts(cols)[:, None])})["g"]
    terms = [("parametric", np.arange(design.n_parametric))] + [(s.label, np.arange(s.slice.start, s.slice.stop)) for s in design.smooths]

    def worst(a: np.ndarray, b: np.ndarray) -> float:
        if not len(a) or not len(b):
            return 0.0
        gaa, gbb, gab = g[np.ix_(a, a)], g[np.ix_(b, b)], g[np.ix_(a, b)]
        va, ea = np.linalg.eigh(gaa)
        ok = va > 1e-10 * va[-1]
        half = ea[:, ok] / np.sqrt(va[ok])
        return float(np.clip(np.linalg.eigvalsh(half.T @ gab @ np.linalg.pinv(gbb, 1e-10, hermitian=True) @ gab.T @ half)[-1], 0, 1))

    if full:
        return {name: worst(at, np.concatenate([b for n, b in terms if n != name] or [np.zeros(0, int)])) for name, at in terms}
    return {(a, b): worst(x, y) for a, x in terms for b, y in terms if a != b}


def anova_gam(*models: GamModel) -> DataFrame:
    """Wald tests of one model's smooths, or sequential deviance tests of several nested models."""
    if len(models) == 1:
        return _frame(models[0], models[0].smooth_tests(), "label string, edf double, ref_df double, statistic double, p_value double")
    order = sorted(models, key=lambda x: x.model_edf())
    big = order[-1]
    rows = []
    for i, x in enumerate(order):
        if not i:
            rows.append((x.dof_residual(), x.deviance, None, None, None, None))
            continue
        before = order[i - 1]
        d = max(x.model_edf() - before.model_edf(), 1e-6)
        dev = before.deviance - x.deviance
        if x.family.known_scale:
            stat, p = dev, chi2_sf(dev, d)
        else:
            stat = dev / d / big.scale
            p = f_sf(stat, d, big.dof_residual())
        rows.append((x.dof_residual(), x.deviance, d, dev, stat, p))
    return _frame(big, rows, "resid_df double, resid_dev double, df double, deviance double, statistic double, p_value double")


def _typical(m: GamModel) -> dict:
    """Medians of numeric columns, the most frequent levels of factors."""
    t, out = m.table, {}
    numeric = m._numeric()
    for c in m.needed():
        if c in numeric:
            out[c] = float(t.agg(F.percentile_approx(c, 0.5, 100_000)).first()[0])
        else:
            out[c] = t.groupBy(c).count().orderBy(F.desc("count"), c).first()[0]
    return out


def data_slice(m: GamModel, **values) -> DataFrame:
    """All combinations of the given values, other columns at their typical values. ``x=50`` asks for so many
    points over the column's range."""
    base = _typical(m)
    numeric = m._numeric()
    out = None
    spark = m._spark()
    for c, typical in base.items():
        v = values.get(c, [typical])
        if isinstance(v, int) and c in numeric:
            lo, hi = m.table.agg(F.min(c), F.max(c)).first()
            v = np.linspace(lo, hi, v).tolist()
        kind = "double" if c in numeric else dict(m.table.dtypes)[c]
        one = spark.createDataFrame([(x,) for x in v], f"`{c}` {kind}")
        out = one if out is None else out.crossJoin(one)
    return out


def _grid(m: GamModel, s, n: int) -> dict[str, np.ndarray]:
    axes = []
    numeric = m._numeric()
    for v in s.spec.vars:
        if v in numeric:
            lo, hi = m.table.agg(F.min(v), F.max(v)).first()
            axes.append(np.linspace(lo, hi, n if len(s.spec.vars) == 1 else max(2, round(n ** (1 / len(s.spec.vars))) * 3)))
        else:
            axes.append(np.array(m.rows.levels(v), object))
    mesh = np.meshgrid(*axes, indexing="ij")
    cols = {v: x.ravel() for v, x in zip(s.spec.vars, mesh, strict=True)}
    size = len(mesh[0].ravel())
    if s.numeric_by:
        cols[s.spec.by] = np.ones(size)
    elif s.level is not None:
        cols[s.spec.by] = np.array([s.level] * size, object)
    return cols


def _chosen(m: GamModel, select):
    return [s for s in m.design.smooths if select is None or s.label in ([select] if isinstance(select, str) else select)]


def smooth_estimates(m: GamModel, select=None, n: int = 100, data: DataFrame | None = None):
    """label, covariates, estimate, se on a grid over each smooth's range (Cartesian in several dimensions), or the
    rows of ``data`` with columns per smooth."""
    chosen = _chosen(m, select)
    if data is not None:
        beta, vp = m.beta, m.vp
        names = [x for s in chosen for x in (f"est[{s.label}]", f"se[{s.label}]")]

        def block(cols):
            out = {}
            for s in chosen:
                x = s.columns(cols)
                out[f"est[{s.label}]"] = x @ beta[s.slice]
                out[f"se[{s.label}]"] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, vp[s.slice, s.slice], x), 0))
            return out

        needed = list(dict.fromkeys(v for s in chosen for v in (*s.spec.vars, *([s.spec.by] if s.spec.by else []))))
        return add_columns(data, needed, block, names, m._numeric())
    rows, columns = [], list(dict.fromkeys(v for s in chosen for v in s.spec.vars))
    for s in chosen:
        cols = _grid(m, s, n)
        x = s.columns(cols)
        est = x @ m.beta[s.slice]
        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, m.vp[s.slice, s.slice], x), 0))
        for i in range(len(est)):
            rows.append((s.label, *(_plain(cols[v][i]) if v in cols else None for v in columns), float(est[i]), float(se[i])))
    numeric = m._numeric()
    kinds = dict(m.table.dtypes)
    schema = "label string, " + "".join(f"`{v}` {'double' if v in numeric else kinds[v]}, " for v in columns) + "estimate double, se double"
    return _frame(m, rows, schema)


def _plain(v):
    return v.item() if isinstance(v, np.generic) else v


def partial_residuals(m: GamModel, select=None, type: str = "response") -> DataFrame:
    """The table with a column per smooth: its estimate plus response or working residuals."""
    out = smooth_estimates(m, select, data=m.residuals(type))
    for s in _chosen(m, select):
        out = out.withColumn(f"partial[{s.label}]", F.col(f"`est[{s.label}]`") + F.col("resid"))
    return out


def derivatives(m: GamModel, select=None, order: int = 1, type: str = "central", n: int = 100, eps: float | None = None, level: float = 0.95, interval: str = "confidence", draws: int = 5000, seed: int = 1) -> DataFrame:
    """label, x, derivative, se, lower, upper of one-dimensional smooths by finite differences; pointwise limits, or
    simultaneous ones from the largest absolute standardised deviation of posterior draws."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in _chosen(m, select):
        if len(s.spec.vars) != 1 or s.spec.vars[0] not in m._numeric():
            continue
        v = s.spec.vars[0]
        cols = _grid(m, s, n)
        span = cols[v][-1] - cols[v][0]
        h = eps or (1e-4 if order == 1 else 1e-3) * span

        def at(d, cols=cols, v=v, s=s):
            return s.columns({**cols, v: cols[v] + d})

        if order == 2:
            x = (at(h) + at(-h) - 2 * at(0.0)) / h**2
        else:
            x = {"central": lambda: (at(h / 2) - at(-h / 2)) / h, "forward": lambda: (at(h) - at(0.0)) / h, "backward": lambda: (at(0.0) - at(-h)) / h}[type]()
        d = x @ m.beta[s.slice]
        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, m.vp[s.slice, s.slice], x), 0))
        if interval == "simultaneous":
            z = _draws(np.zeros(s.width), m.vp[s.slice, s.slice], draws, rng) @ x.T
            q = float(np.quantile(np.abs(z / np.maximum(se, 1e-300)).max(axis=1), level))
        else:
            q = float(normal_ppf((1 + level) / 2))
        rows += [(s.label, float(a), float(b), float(c), float(b - q * c), float(b + q * c)) for a, b, c in zip(cols[v], d, se, strict=True)]
    return _frame(m, rows, "label string, x double, derivative double, se double, lower double, upper double")


def _draws(mean, cov, n, rng) -> np.ndarray:
    value, vector = np.linalg.eigh((cov + cov.T) / 2)
    return mean + rng.standard_normal((n, len(mean))) * np.sqrt(np.maximum(value, 0)) @ vector.T


def posterior_samples(m, n: int = 1000, seed: int = 1) -> np.ndarray:
    """Draws of the coefficients, n x p."""
    return _draws(np.asarray(m.beta), m.vp, n, np.random.default_rng(seed))


def fitted_samples(m: GamModel, n: int = 100, newdata: DataFrame | None = None, type: str = "response", seed: int = 1) -> DataFrame:
    """The table with ``samples``, an array of n draws of each row's expectation."""
    df = m.table if newdata is None else newdata
    design, family, b = m.design, m.family, posterior_samples(m, n, seed)

    def block(cols):
        eta = design.matrix(cols) @ b.T
        return {"samples[]": family.link.inv(eta) if type == "response" else eta}

    return add_columns(df, m.needed(), block, ["samples[]"], m._numeric())


def predicted_samples(m: GamModel, n: int = 100, newdata: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """The table with ``samples``, an array of n simulated responses; a row's draws depend on its values and the
    seed, not on where it lies."""
    df = m.table if newdata is None else newdata
    design, family, beta, scale = m.design, m.family, m.beta, m.scale

    def block(cols):
        mu = family.clip(family.link.inv(design.matrix(cols) @ beta))
        out = np.zeros((len(mu), n))
        for i, v in enumerate(mu):
            rng = np.random.default_rng([seed, int(np.float64(v).view(np.uint64))])
            out[i] = family.simulate(np.full(n, v), np.ones(n), scale, rng)
        return {"samples[]": out}

    return add_columns(df, m.needed(), block, ["samples[]"], m._numeric())


def smooth_samples(m: GamModel, select=None, n: int = 100, grid: int = 50, seed: int = 1) -> DataFrame:
    """label, draw, x, value: draws of one-dimensional smooths on a grid."""
    rows = []
    b = posterior_samples(m, n, seed)
    for s in _chosen(m, select):
        if len(s.spec.vars) == 1 and s.spec.vars[0] in m._numeric():
            cols = _grid(m, s, grid)
            f = b[:, s.slice] @ s.columns(cols).T
            rows += [(s.label, d, float(x), float(v)) for d in range(n) for x, v in zip(cols[s.spec.vars[0]], f[d], strict=True)]
    return _frame(m, rows, "label string, draw int, x double, value double")


def appraise(m: GamModel, type: str = "deviance") -> DataFrame:
    """The table with resid, fit, linear predictor, and theoretical: the normal quantile of the residual's rank. Ranks
    come from one global order: ranges between fixed bounds, which a row falls in by its residual alone whenever it is
    computed, counts per range, and ranks within. Equal residuals are in one range, in any order."""
    fit = m.predict(m.residuals(type))
    spark = fit.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), m.n // 1_000_000)
    probs = [i / ranges for i in range(1, ranges)]
    bounds = np.unique(fit.agg(F.percentile_approx("resid", F.array(*map(F.lit, probs)), 10 * ranges)).first()[0]) if probs else np.zeros(0)
    ranged = add_columns(fit, ["resid"], lambda cols: {"__part": np.searchsorted(bounds, cols["resid"]).astype(float)}, ["__part"])
    ranged = ranged.withColumn("__part", F.col("__part").cast("int"))
    local = ranged.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy("resid")))
    counts = {r[0]: r[1] for r in ranged.groupBy("__part").count().collect()}  # a row per range
    base, rows = 0, []
    for p in sorted(counts):
        rows.append((p, base))
        base += counts[p]
    offsets = spark.createDataFrame(rows, "__part int, __base long")
    p = (F.col("__rank") + F.col("__base") - 0.5) / F.lit(float(base))
    ranked = local.join(F.broadcast(offsets), "__part").withColumn("prob", p).drop("__part", "__rank", "__base")
    return add_columns(ranked, ["prob"], lambda cols: {"theoretical": normal_ppf(cols["prob"])}, ["theoretical"])


def rootogram(m: GamModel, most: int | None = None) -> DataFrame:
    """count, observed, expected and their square roots, for counts from zero."""
    design, beta, family, y = m.design, m.beta, m.family, m.design.formula.response
    if not hasattr(family, "pmf"):
        raise ValueError("a rootogram needs a count family")
    top = int(most if most is not None else m.table.agg(F.max(y)).first()[0])
    observed = {int(r[0]): r[1] for r in m.table.where(F.col(y) <= top).groupBy(y).count().collect()}

    def block(cols):
        mu = family.clip(family.link.inv(design.matrix(cols) @ beta + cols["__offset"]))
        n = row_counts(cols)
        return {"e": np.array([n @ family.pmf(k, mu) for k in range(top + 1)])}

    e = m.rows.sweep(block)["e"]
    rows = [(k, float(observed.get(k, 0)), float(e[k]), math.sqrt(observed.get(k, 0)), math.sqrt(e[k])) for k in range(top + 1)]
    return _frame(m, rows, "count int, observed double, expected double, sqrt_observed double, sqrt_expected double")


def row_distances(m: GamModel, view: tuple[str, str], n: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grid of the first column, of the second, distance of each grid point from the nearest row, in units of the ranges).

    Exact: a task holds the grid against each of its batches, in parts that stay in cache, and hands on the least distances."""
    a, b = view
    r = m.rows.range([a, b])
    (la, wa), (lb, wb) = ((r[c][0], r[c][1] - r[c][0] or 1.0) for c in (a, b))
    ga, gb = np.linspace(*r[a], n), np.linspace(*r[b], n)
    pa, pb = np.repeat((ga - la) / wa, n), np.tile((gb - lb) / wb, n)

    def block(cols):
        points = np.unique(np.column_stack([(np.asarray(cols[a], float) - la) / wa, (np.asarray(cols[b], float) - lb) / wb]), axis=0)
        least = np.full(n * n, np.inf)
        for lo in range(0, len(points), 512):
            x, z = points[lo : lo + 512].T
            least = np.minimum(least, ((pa[:, None] - x) ** 2 + (pb[:, None] - z) ** 2).min(axis=1))
        return {"max_near": -least}

    return ga, gb, np.sqrt(-m.rows.sweep(block)["max_near"]).reshape(n, n)


def vis_gam(m: GamModel, view: tuple[str, str] | None = None, n: int = 30, too_far: float = 0.0, type: str = "link", se: bool = False) -> DataFrame:
    """The fitted surface over two columns; grid points farther than ``too_far`` from all rows, in units of the
    ranges, have a null fit."""
    numeric = [c for c in m.needed() if c in m._numeric()]
    a, b = view or (numeric[0], numeric[1])
    out = m.predict(data_slice(m, **{a: n, b: n}), type, se)
    if too_far > 0:
        ga, gb, distance = row_distances(m, (a, b), n)
        near = [(float(x), float(z)) for i, x in enumerate(ga) for j, z in enumerate(gb) if distance[i, j] <= too_far]
        keep = m._spark().createDataFrame(near, f"`{a}` double, `{b}` double").withColumn("__near", F.lit(True))
        out = out.join(F.broadcast(keep), [a, b], "left").withColumn("fit", F.when(F.col("__near"), F.col("fit"))).drop("__near")
    return out


def gamplot(m: GamModel, select=None, n: int = 100) -> DataFrame:
    """What a plot of the smooths needs: estimates with limits of two standard errors."""
    return smooth_estimates(m, select, n).withColumn("lower", F.col("estimate") - 2 * F.col("se")).withColumn("upper", F.col("estimate") + 2 * F.col("se"))


gamcontour = vis_gam

__all__ = [n for n in dir() if not n.startswith("_")] + ["normal_cdf"]
