"""Gaussian additive models over streams: sufficient statistics add up, so each micro-batch adds its Gram matrix and
the model is solved anew on the driver. Knots come from a first table and stay.

With a ``state`` folder the sums outlive the driver. A commit is one row of a table: the design, the sums of all
batches so far and the last batch's id, under the next version number. A stream that is restarted hands in its last batch
once more if it cannot know that it was done; whether it was added is read from the same row as the sums, so every batch
counts exactly once wherever a run was cut off. Versions are written in turn to a few slots, so that the one before stays
until the next is whole, and the table does not grow. A row whose checksum is wrong is passed over.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smoothlake.operators.families import Normal
from smoothlake.operators.gam import OFFSET, WEIGHT, prepare, working_pass
from smoothlake.operators.smoothing import Selector, Working, inverse
from smoothlake.plans.design import bind
from smoothlake.plans.formula import parse
from smoothlake.sources.rows import SparkRows, rows_of

SCHEMA = "version long, batch long, formula string, design binary, g binary, b binary, zz double, n double, checksum long"
SLOTS = 3


class StreamingGam:
    """``add(batch, id)`` is idempotent for ids that rise, as foreachBatch's do; a batch without an id (None) is always
    added. Watermarks and late rows are the stream's own business upstream. One stream at a time feeds a state folder."""

    def __init__(self, formula, first: DataFrame | None = None, method: str = "REML", state: str | None = None):
        self.formula, self.state = parse(formula), state
        self.version, self.last = 0, -1
        self.spark = first.sparkSession if first is not None else SparkSession.getActiveSession()
        kept = self._read() if state else None
        if kept is not None:
            if kept["formula"] != repr(self.formula):
                raise ValueError(f"{state} holds sums of {kept['formula']}")
            self.design = pickle.loads(bytes(kept["design"]))
        elif first is None:
            raise ValueError("knots need a first table, or a state folder that has them")
        else:
            narrow, n, _ = prepare(first, self.formula, None, None, "drop")
            rows = rows_of(narrow, n)
            self.design = bind(self.formula, rows)
            rows.close()
        self.selector = Selector(self.design, method)
        p = self.design.p
        self.g, self.b, self.zz, self.n = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
        if kept is not None:
            self.version, self.last, self.zz, self.n = kept["version"], kept["batch"], kept["zz"], kept["n"]
            self.g, self.b = np.frombuffer(bytes(kept["g"])).reshape(p, p).copy(), np.frombuffer(bytes(kept["b"])).copy()

    def _read(self) -> dict | None:
        """The newest whole version."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.state}/slot=*").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        whole = [r.asDict() for r in rows if r.checksum == _checksum(r.version, r.batch, bytes(r.g), bytes(r.b), r.zz, r.n)]
        return max(whole, key=lambda r: r["version"], default=None)

    def _commit(self, batch: int, g, b, zz: float, n: float) -> None:
        version = self.version + 1
        row = (version, batch, repr(self.formula), pickle.dumps(self.design), g.tobytes(), b.tobytes(), zz, n, _checksum(version, batch, g.tobytes(), b.tobytes(), zz, n))
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.state}/slot={version % SLOTS}")
        self.version = version

    def add(self, batch: DataFrame, batch_id: int | None = None) -> None:
        if batch_id is not None and batch_id <= self.last:
            return
        columns = [c for c in self.formula.columns]
        narrow = batch.select(*columns).dropna().withColumn(WEIGHT, F.lit(1.0)).withColumn(OFFSET, F.lit(0.0))
        r = SparkRows(narrow, 0).sweep(working_pass(self.design, Normal(), self.formula.response, None))
        g, b, zz, n = self.g, self.b, self.zz, self.n
        if r:
            g, b, zz, n = g + r["g"], b + r["b"], zz + float(r["s"][0]), n + float(r["s"][5])
        last = self.last if batch_id is None else int(batch_id)
        if self.state:
            self._commit(last, g, b, zz, n)
        self.g, self.b, self.zz, self.n, self.last = g, b, zz, n, last

    def solve(self) -> dict:
        """Coefficients, smoothing parameters, freedom and scale of what has arrived."""
        w = Working(self.g, self.b, self.zz, self.n)
        rho = self.selector.select(w)
        inv = inverse(self.g + self.selector.penalty(rho))
        beta = inv @ self.b
        edf = float((inv * self.g).sum())
        rss = max(self.zz - 2 * beta @ self.b + beta @ self.g @ beta, 0.0)
        return {"beta": beta, "log_sp": rho, "edf": edf, "scale": rss / max(self.n - edf, 1e-6), "n": self.n}

    def attach(self, stream: DataFrame, checkpoint: str | None = None, available_now: bool = False, **options):
        """Starts a streaming query that feeds this model. With a ``checkpoint`` the model needs a ``state`` folder: the
        stream goes on after the batches that it knows of, and so must the sums."""
        if checkpoint and not self.state:
            raise ValueError("a stream with a checkpoint goes on where it was; its sums need a state folder to do so, too")
        writer = stream.writeStream.foreachBatch(self.add).options(**options)
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def _checksum(version: int, batch: int, g: bytes, b: bytes, zz: float, n: float) -> int:
    return zlib.crc32(repr((version, batch, zz, n)).encode() + g + b)
