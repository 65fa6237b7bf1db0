"""Knots and covariate bins as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smoothlake.sources.rows import order_statistics


def place_knots(df: DataFrame, column: str, k: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """knot_id, knot: k quantiles of the distinct values, ends included; with lo and hi, the interior ones between."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null").distinct()
    if lo is not None:
        x = x.where((F.col("x") > lo) & (F.col("x") < hi))
    return _knots(x, [i / (k + 1) for i in range(1, k + 1)] if lo is not None else [i / (k - 1) for i in range(k)])


def knot_quantiles(df: DataFrame, column: str, n: int) -> DataFrame:
    """knot_id, knot: ``n`` evenly spaced quantiles of the distinct values, ends left out."""
    if n < 0:
        raise ValueError("a number of knots is not negative")
    return _knots(df.select(F.col(column).cast("double").alias("x")).where("x is not null").distinct(), [i / (n + 1) for i in range(1, n + 1)])


def _knots(distinct: DataFrame, probs: list[float]) -> DataFrame:
    found = order_statistics(distinct.withColumn("n", F.lit(1)), probs) if probs else []
    return distinct.sparkSession.createDataFrame(list(enumerate(found)), "knot_id int, knot double")


def discretize_covariates(df: DataFrame, column: str, max_unique: int = 1000) -> DataFrame:
    """The table with ``bin`` and ``bin_mid``: each distinct value where there are at most ``max_unique``; else the
    ranges between that many quantiles of the rows, with their middles, the first and the last at the ends."""
    x = F.col(column).cast("double")
    found = [r.x for r in df.select(x.alias("x")).where("x is not null").distinct().limit(max_unique + 1).collect()]
    if len(found) <= max_unique:
        breaks = middles = sorted(found)
    else:
        counted = df.groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
        breaks = sorted(set(order_statistics(counted, [i / max_unique for i in range(max_unique + 1)])))
        middles = [(a + b) / 2 for a, b in zip(breaks, breaks[1:], strict=False)]
        middles[0], middles[-1] = breaks[0], breaks[-1]
    # the last break at or below the value
    edges = F.array(*map(F.lit, breaks))
    at = F.least(F.greatest(F.size(F.filter(edges, lambda b: b <= x)) - 1, F.lit(0)), F.lit(len(middles) - 1))
    out = df.withColumn("bin", F.when(x.isNotNull(), at).cast("int"))
    return out.withColumn("bin_mid", F.when(x.isNotNull(), F.array(*map(F.lit, middles))[at]))


def equal_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """The table with ``bin`` and ``bin_mid``: equal ranges of the column."""
    span = df.agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
    wide = df.crossJoin(F.broadcast(span))  # one row
    step = (F.col("__hi") - F.col("__lo")) / bins
    number = F.when(step > 0, F.least(F.floor((F.col(column) - F.col("__lo")) / step), F.lit(bins - 1))).otherwise(0).cast("int")
    return wide.withColumn("bin", number).withColumn("bin_mid", F.col("__lo") + (F.col("bin") + 0.5) * step).drop("__lo", "__hi")


def laplacian(edges: DataFrame, a: str, b: str) -> DataFrame:
    """region, degree: the diagonal of a Markov random field's penalty, from its undirected edges."""
    both = edges.select(F.col(a).alias("region"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("region"), F.col(a).alias("other")))
    return both.where("region <> other").distinct().groupBy("region").agg(F.count(F.lit(1)).alias("degree"))
