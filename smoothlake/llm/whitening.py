"""Whitening of embeddings by MLlib's singular value decomposition of centred distributed rows.

Entries become integers ``floor(scale * c)``, so sums over rows are exact. The fit list holds each distinct
integer vector once. Its rows, centred by the exact mean, form a ``RowMatrix`` whose ``computeSVD`` gives the
right singular vectors (the components) and the singular values; squared and divided by the number n of
rows these are the covariance's eigenvalues. The total variance does not come from them: it is the sum of the
exact integer deviations ``(n x - S)^2``, divided by n cubed.

All components are asked of ``computeSVD`` and the first ones used: MLlib then decomposes the summed Gram
matrix densely and to double precision, where a few components alone would be iterated to 1e-10 only. What
reaches the driver is that matrix, d x d for d dimensions. Rows are never collected.

Edge cases: a row whose vector is null, empty or holds a null, NaN or infinite entry is left out, and so is one
whose length differs from that of most remaining rows (the greater length, if two are equally frequent), since
it has no place in the same covariance. Repeated rows are fitted once and all returned; equal or null vec_ids
are rows like others. Components whose variance is no more than rounding (``flat`` of the largest) are not
returned, so equal vectors, a single vector or an empty table give no rows. Entries beyond a 64-bit
integer are taken as the largest one; a deviation beyond 64 bits is null. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged, tune


@dataclass(frozen=True)
class WhiteningOptions:
    """scale: integer steps per unit. components: how many are returned. flat: variances of this part of the
    largest and below count as none. column: that of the vectors."""

    scale: int = 256
    components: int = 4
    flat: float = 1e-13
    column: str = "embedding"


@dataclass
class Whitening:
    """A fit: n rows with sums S per dimension; the components (rows of a matrix) with their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    total: float
    error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """[rows, components]: whitened coordinates of integer rows."""
        mean = np.array([float(s / self.n) for s in self.sums])
        return (x.astype(float) - mean) @ self.components.T / np.sqrt(self.values)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n x - S)^2 for each row."""
    widest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums), default=0)
    if widest * widest * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def integers(embeddings: DataFrame, options: WhiteningOptions = WhiteningOptions()) -> DataFrame:
    """(vec_id, x): the rows that take part, their entries as integers."""
    entry = F.col("v").cast("array<double>")
    whole = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    widest = float(2**63 - 1024)  # the largest double below the largest 64-bit integer
    steps = F.transform(entry, lambda c: F.floor(F.greatest(F.least(c * float(options.scale), F.lit(widest)), F.lit(-widest))).cast("long"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(options.column).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(whole)
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    return rows.where(F.size("v") == size).select("vec_id", steps.alias("x"))


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def _sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension, by partial sums per task."""
    out = pa.schema([("at", pa.int32()), ("s", pa.decimal128(38, 0))])

    def partial(batches):
        sums: list[int] | None = None
        n = 0
        for b in batches:
            x = _matrix(b.column(0))
            if not len(x):
                continue
            n += len(x)
            wide = max(abs(int(x.max())), abs(int(x.min()))) * len(x) >= 1 << 63
            part = [sum(c) for c in x.T.tolist()] if wide else x.sum(axis=0).tolist()
            sums = part if sums is None else [a + c for a, c in zip(sums, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(sums))], pa.int32()), pa.array([n, *sums], pa.decimal128(38, 0))], schema=out)

    rows = distinct.select("x").mapInArrow(partial, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()
    found = {r["at"]: int(r["s"]) for r in rows}
    n = found.pop(-1, 0)
    return n, [found[j] for j in range(len(found))]


def _total(distinct: DataFrame, n: int, sums: list[int]) -> float:
    """The covariance's trace from exact deviations."""

    def partial(batches):
        total = sum(sum(deviations(_matrix(b.column(0)), n, sums)) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_pydict({"high": [total >> 60], "low": [total & (1 << 60) - 1]}, schema=pa.schema([("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))]))

    row = distinct.select("x").mapInArrow(partial, "high decimal(38,0), low decimal(38,0)").agg(F.sum("high"), F.sum("low")).first()
    exact = (int(row[0] or 0) << 60) + int(row[1] or 0)
    return exact / n**3  # of two integers: rounded once


def fit(x: DataFrame, options: WhiteningOptions = WhiteningOptions()) -> Whitening:
    """Fits components to the distinct rows of ``x``."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    distinct = staged(x.select("x").distinct(), "whitening")
    n, sums = _sums(distinct)
    d = len(sums)
    none = Whitening(n, sums, np.empty((0, d)), np.empty(0), 0.0)
    total = _total(distinct, n, sums) if n else 0.0
    if not total:
        return none
    mean = F.array(*[F.lit(float(s / n)) for s in sums])
    centred = distinct.select(array_to_vector(F.zip_with(F.col("x").cast("array<double>"), mean, lambda a, m: a - m)).alias("v"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, d).computeSVD(d, computeU=False, rCond=1e-12)
    values = np.asarray(svd.s.toArray()) ** 2 / n  # singular values to variances, divisor n
    keep = [j for j in range(min(options.components, len(values))) if values[j] > options.flat * values[0]]
    found = Whitening(n, sums, np.asarray(svd.V.toArray()).T[keep], values[keep], total)
    found.error = _identity_error(distinct, found)
    return found


def _identity_error(distinct: DataFrame, w: Whitening) -> float:
    """Largest entry by which the whitened rows' covariance (centred as it is summed) differs from the identity."""
    k = len(w.values)
    names = [f"w{j}" for j in range(k)]

    def rows(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in w.project(_matrix(b.column(0))).T], names)

    whitened = distinct.select("x").mapInArrow(rows, ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    row = whitened.agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, options: WhiteningOptions = WhiteningOptions(), fitted: Whitening | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    tune(embeddings.sparkSession)
    x = integers(embeddings, options)
    w = fitted or fit(x, options)
    k, d = len(w.values), len(w.sums)
    explained = w.values / w.total if k else w.values

    def rows(batches):
        for b in batches:
            if not k or not b.num_rows:
                continue
            m = _matrix(b.column(1))
            if m.shape[1] != d:
                raise ValueError(f"vectors of {m.shape[1]} entries, a fit of {d}")
            exact = [v if v < 1 << 63 else None for v in deviations(m, w.n, w.sums)]
            rows = len(m)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, w.n, np.int64)),
                    pa.array([v for v in exact for _ in range(k)], pa.int64()),
                    pa.array(w.project(m).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, w.error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(rows, SCHEMA)
