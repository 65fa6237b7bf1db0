"""Gaussian mixed models with a random intercept of any number of levels.

The level effects are eliminated by a Schur complement: a table of per-level sums (rows, columns of the smooth part,
response) stays on the cluster, one row per level. For a ratio of residual to group variance, its contribution to the
normal equations of the smooth part is a sum over that table; one pass evaluates a grid of ratios, a second one a finer
grid, and everything else is algebra of the smooth part's size on the driver.

At a given ratio one pass is enough. Centred effects sum to zero over the rows, as those of a smooth ``s(group, bs='re')``
do: the multiplier of that condition is one more column of the smooth part, whose sums are the levels' numbers of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smoothlake.operators.families import Normal
from smoothlake.operators.gam import OFFSET, WEIGHT, prepare, working_pass
from smoothlake.operators.gamm import with_groups
from smoothlake.operators.rowmap import add_columns
from smoothlake.operators.smoothing import Selector, Working, inverse
from smoothlake.plans.design import Design, bind
from smoothlake.plans.formula import parse
from smoothlake.sources.rows import rows_of, to_columns


@dataclass
class LargeGammModel:
    design: Design
    group: str
    beta: np.ndarray
    log_sp: np.ndarray
    scale: float
    ratio: float
    n: int
    levels: int
    vp: np.ndarray
    table: DataFrame
    sums: DataFrame
    multiplier: float = 0.0  # of the condition that effects sum to zero

    def ranef(self) -> DataFrame:
        """level, effect: a DataFrame with a row per level."""
        p, beta, ratio = self.design.p, self.beta, self.ratio
        left = F.col("s_z") - F.col("s_n") * F.lit(self.multiplier) if self.multiplier else F.col("s_z")
        for i in range(p):
            left = left - F.col(f"s_{i}") * F.lit(float(beta[i]))
        return self.sums.select(F.col("level"), (left / (F.col("s_w") + F.lit(ratio))).alias("effect"))

    def varcorr(self) -> DataFrame:
        rows = [(self.group, "(Intercept)", self.scale / self.ratio, (self.scale / self.ratio) ** 0.5, self.levels), ("Residual", "", self.scale, self.scale**0.5, 0)]
        return self.table.sparkSession.createDataFrame(rows, "group string, label string, variance double, std double, n_levels long")

    def predict(self, newdata: DataFrame | None = None) -> DataFrame:
        """The table with ``fit``: smooth part plus the level's effect, none for unseen levels."""
        df = self.table if newdata is None else newdata
        design, beta = self.design, self.beta
        needed = [c for c in design.formula.columns if c != design.formula.response]
        out = add_columns(df, needed, lambda cols: {"__fixed": design.matrix(cols) @ beta}, ["__fixed"])
        joined = out.join(self.ranef().withColumnRenamed("level", "__level"), F.col(f"`{self.group}`") == F.col("__level"), "left")
        return joined.withColumn("fit", F.col("__fixed") + F.coalesce("effect", F.lit(0.0))).drop("__fixed", "__level", "effect")


def level_sums(df: DataFrame, design: Design, group: str, response: str) -> DataFrame:
    """level, s_w, s_z, s_n, s_0 .. s_(p-1): sums per level, added up within tasks before the shuffle."""
    p = design.p
    names = ["s_w", "s_z", "s_n", *[f"s_{i}" for i in range(p)]]
    kind = dict(df.dtypes)[group]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cols = to_columns(b)
            x, w, z = design.matrix(cols), np.asarray(cols[WEIGHT], float), np.asarray(cols[response], float) - cols[OFFSET]
            values = np.column_stack([w, w * z, np.ones(len(w)), x * w[:, None]])
            level, code = np.unique(cols[group], return_inverse=True)
            total = np.zeros((len(level), p + 3))
            np.add.at(total, code, values)
            yield pa.RecordBatch.from_arrays([pa.array(level.tolist()), *[pa.array(c) for c in total.T]], ["level", *names])

    parts = df.mapInArrow(run, f"level {'double' if kind == 'double' else kind}, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("level").agg(*[F.sum(n).alias(n) for n in names])


def gamm_large(formula, df: DataFrame, method: str = "REML", weights: str | None = None, na_action: str = "fail", rounds: int = 3, ratio: float | None = None, centred: bool = False) -> LargeGammModel:
    """``y ~ smooths + (1 | group)``, Gaussian with identity link. ratio: residual over group variance (the ``sp`` of
    ``s(group, bs='re')``), to be held; None estimates it. centred: effects sum to zero over the rows."""
    f = parse(formula)
    if len(f.random) != 1 or f.random[0].terms != ("1",) or len(f.random[0].group) != 1:
        raise ValueError("one random intercept (1 | group) is wanted")
    group = f.random[0].group[0]
    fixed = type(f)(f.response, f.parametric, f.intercept, f.smooths)
    narrow, n, _ = prepare(with_groups(df, f.random), f, weights, None, na_action)
    rows = rows_of(narrow, n, 0)
    design = bind(fixed, rows)
    r = rows.sweep(working_pass(design, Normal(), f.response, None))
    g, b, zz = r["g"], r["b"], float(r["s"][0])
    sums = level_sums(narrow, design, group, f.response).persist()
    levels = sums.count()
    selector = Selector(design, method)
    p, wide = design.p, design.p + centred
    per_level = rows_of(sums.drop("level"), levels)

    def reduced(ratios: np.ndarray):
        def block(cols):
            x = np.column_stack([*(cols[f"s_{i}"] for i in range(p)), *([cols["s_n"]] if centred else [])])
            out = {"g": np.zeros((len(ratios), wide, wide)), "b": np.zeros((len(ratios), wide)), "z": np.zeros(len(ratios)), "d": np.zeros(len(ratios))}
            for i, t in enumerate(ratios):
                k = 1 / (cols["s_w"] + t)
                out["g"][i] = x.T @ (x * k[:, None])
                out["b"][i] = x.T @ (k * cols["s_z"])
                out["z"][i] = (k * cols["s_z"] ** 2).sum()
                out["d"][i] = np.log((cols["s_w"] + t) / t).sum()
            return out

        s = per_level.sweep(block)
        found = []
        for i in range(len(ratios)):
            gi, bi, zi, di = g - s["g"][i][:p, :p], b - s["b"][i][:p], zz - float(s["z"][i]), float(s["d"][i])
            if centred:
                side, cross, right = float(s["g"][i][p, p]), s["g"][i][:p, p], float(s["b"][i][p])
                gi, bi, zi = gi + np.outer(cross, cross) / side, bi + cross * (right / side), zi + right**2 / side
                di += float(np.log(ratios[i] * side))
            w = Working(gi, bi, zi, n)
            rho = selector.select(w, newton=3)
            found.append((selector.score(rho, w) + 0.5 * di, i, rho, w))
        best = min(found, key=lambda x: x[0])
        return *best, s["g"][best[1]][p:, :], s["b"][best[1]][p:]

    lo, hi = -6.0, 10.0
    for _ in range(rounds if ratio is None else 1):
        grid = np.linspace(lo, hi, 17) if ratio is None else np.log([float(ratio)])
        _, i, rho, w, side, right = reduced(np.exp(grid) if ratio is None else np.array([float(ratio)]))
        best = grid[i]
        lo, hi = (best - (grid[1] - grid[0]), best + (grid[1] - grid[0])) if ratio is None else (best, best)
    inv = inverse(w.g + selector.penalty(rho))
    beta = inv @ w.b
    dp = max(w.zz - beta @ w.b, 1e-300)
    scale = dp / max(n - (p - selector.rank), 1)
    multiplier = float((right[0] - side[0, :p] @ beta) / side[0, p]) if centred else 0.0
    return LargeGammModel(design, group, beta, rho, float(scale), float(np.exp(best)) if ratio is None else float(ratio), n, levels, inv * scale, narrow, sums, multiplier)
