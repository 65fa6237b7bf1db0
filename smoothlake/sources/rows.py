"""Rows of a model: the passes over the data that every fitter needs, on Spark or on a small local table.

A pass sends a function over blocks of columns and adds up the arrays it returns. On Spark a block is an
Arrow batch, each task adds up its own blocks, and the tasks' sums are added up in packed pieces, ``FAN`` tasks at
a time. A table of at most ``LOCAL`` rows, counted first, is held by the driver instead, so a fit of a small or
compressible table costs a few jobs however many iterations it takes.
"""

from __future__ import annotations

import math
import struct
import weakref
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL = 200_000
PIECE = 8192  # numbers of a packed piece of a task's sums
FAN = 64  # pieces that one task adds up at most
Columns = dict[str, np.ndarray]
Pass = Callable[[Columns], dict[str, np.ndarray]]


def to_columns(table) -> Columns:
    out = {}
    for name in table.schema.names:
        c = table.column(name)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            out[name] = np.array(c.to_pylist(), object)
        else:
            out[name] = np.asarray(c.to_numpy(zero_copy_only=False))
    return out


def size_of(columns: Columns) -> int:
    return len(next(iter(columns.values()))) if columns else 0


def row_counts(columns: Columns) -> np.ndarray:
    """How many rows of the table each row of a block stands for: several, where rows were compressed."""
    return np.asarray(columns["__rows"], float) if "__rows" in columns else np.ones(size_of(columns))


class LocalRows:
    """Rows the driver holds."""

    def __init__(self, columns: Columns):
        self.columns, self.n = columns, size_of(columns)

    def sweep(self, f: Pass, block: int = 50_000) -> dict[str, np.ndarray]:
        total: dict[str, np.ndarray] = {}
        for lo in range(0, self.n, block):
            _add(total, f({k: v[lo : lo + block] for k, v in self.columns.items()}))
        return total

    def range(self, names: list[str]) -> dict[str, tuple[float, float]]:
        return {n: (float(np.min(self.columns[n])), float(np.max(self.columns[n]))) for n in names}

    def quantiles(self, name: str, probs: np.ndarray) -> np.ndarray:
        return np.quantile(np.unique(self.columns[name].astype(float)), probs)

    def distinct_count(self, name: str) -> int:
        return len(np.unique(self.columns[name].astype(float)))

    def distinct(self, name: str) -> np.ndarray:
        return np.unique(self.columns[name].astype(float))

    def levels(self, name: str) -> list:
        return sorted(set(self.columns[name].tolist()))

    def points(self, names: list[str], most: int) -> np.ndarray:
        p = np.unique(np.column_stack([self.columns[n].astype(float) for n in names]) + 0.0, axis=0)
        if len(p) <= most:
            return p
        # the hash that Spark takes of such a row
        import xxhash

        h = [reduce(lambda seed, v: xxhash.xxh64_intdigest(struct.pack("<d", v), seed), row, 42) for row in p.tolist()]
        return p[np.sort(np.lexsort((np.arange(len(p)), np.array(h, np.uint64).view(np.int64)))[:most])]

    def select(self, f: Callable[[Columns], Columns]) -> LocalRows:
        return LocalRows(f(self.columns))

    def close(self) -> None:
        """Nothing is held on the cluster."""


class SparkRows:
    """Rows that stay on the cluster; ``df`` holds the model's columns only. ``held``: persisted tables that are freed
    by ``close`` or when nothing refers to the rows any more."""

    def __init__(self, df: DataFrame, n: int, held: tuple[DataFrame, ...] = ()):
        self.df, self.n = df, n
        self._tasks: int | None = None
        self._free = weakref.finalize(self, _free, held)
        self._free.atexit = False  # the session goes with its storage

    def close(self) -> None:
        self._free()

    @property
    def tasks(self) -> int:
        if self._tasks is None:
            self._tasks = max(1, self.df.rdd.getNumPartitions())
        return self._tasks

    def sweep(self, f: Pass) -> dict[str, np.ndarray]:
        """Sums over all rows of what ``f`` returns; names that begin with ``max_`` are maxima. A task hands on its sums
        in packed pieces of ``PIECE`` numbers; these are added up on the executors in levels, the same piece of
        ``FAN`` tasks by one task, until one is left of each."""
        schema = "name string, shape array<int>, at int, task int, v binary"
        fields = pa.schema([("name", pa.string()), ("shape", pa.list_(pa.int32())), ("at", pa.int32()), ("task", pa.int32()), ("v", pa.binary())])

        def row(name, shape, at, task, v):
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((name, shape, at, task, v.tobytes()), fields, strict=True)], schema=fields)

        def run(batches):
            from pyspark import TaskContext

            task = TaskContext.get().partitionId()
            total: dict[str, np.ndarray] = {}
            for b in batches:
                if b.num_rows:
                    _add(total, f(to_columns(b)))
            for name, v in total.items():
                flat = np.ascontiguousarray(v, float).ravel()
                for at in range(0, len(flat), PIECE):
                    yield row(name, list(v.shape), at, task, flat[at : at + PIECE])

        def add(batches):  # sorted, so one sum is held at a time
            key, total = None, None
            for b in batches:
                for name, shape, at, task, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    v = np.frombuffer(v)
                    if key is not None and key[0] == name and key[2:] == (at, task):
                        total = np.maximum(total, v) if name.startswith("max_") else total + v
                        continue
                    if key is not None:
                        yield row(*key, total)
                    key, total = (name, shape, at, task), v
            if key is not None:
                yield row(*key, total)

        parts = self.df.mapInArrow(run, schema)
        for _ in range(levels(self.tasks)):
            parts = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int"))
            parts = parts.repartition("name", "at", "task").sortWithinPartitions("name", "at", "task").mapInArrow(add, schema)
        out: dict[str, np.ndarray] = {}
        for name, shape, at, _, v in parts.collect():
            v = np.frombuffer(v)
            out.setdefault(name, np.zeros(tuple(shape))).reshape(-1)[at : at + len(v)] = v
        return out

    def range(self, names: list[str]) -> dict[str, tuple[float, float]]:
        r = self.df.agg(*[f(F.col(f"`{n}`").cast("double")) for n in names for f in (F.min, F.max)]).first()
        return {n: (float(r[2 * i]), float(r[2 * i + 1])) for i, n in enumerate(names)}

    def quantiles(self, name: str, probs: np.ndarray) -> np.ndarray:
        """Of the distinct values."""
        x = self.df.select(F.col(f"`{name}`").cast("double").alias("x"))
        return np.array(order_statistics(x.distinct().withColumn("n", F.lit(1)), list(probs)), float)

    def distinct_count(self, name: str) -> int:
        return self.df.select(name).distinct().count()

    def distinct(self, name: str) -> np.ndarray:
        return np.array(sorted(r.x for r in self.df.select(F.col(f"`{name}`").cast("double").alias("x")).distinct().collect()))

    def levels(self, name: str) -> list:
        """Sorted levels of a factor; a model keeps them, so there may be a million at most."""
        got = [r[0] for r in self.df.select(name).distinct().limit(1_000_001).collect()]
        if len(got) > 1_000_000:
            raise ValueError(f"{name} has more than a million levels")
        return sorted(got)

    def points(self, names: list[str], most: int) -> np.ndarray:
        """At most ``most`` distinct points, those with the smallest hashes, in order."""
        d = self.df.select(*[F.col(f"`{n}`").cast("double").alias(n) for n in names]).distinct()
        got = d.orderBy(F.xxhash64(*names), *names).limit(most).collect()
        return np.array(sorted(tuple(r) for r in got), float)

    def select(self, f: Callable[[Columns], Columns]) -> SparkRows:
        raise NotImplementedError("rows on the cluster are prepared as a DataFrame")


def _free(held: tuple[DataFrame, ...]) -> None:
    for df in held:
        try:
            df.unpersist()
        except Exception:  # noqa: BLE001 - the session has ended, and its storage with it
            return


def levels(tasks: int) -> int:
    """Rounds of adding up ``FAN`` at a time until one of ``tasks`` is left."""
    n = 1
    while tasks > FAN:
        tasks, n = math.ceil(tasks / FAN), n + 1
    return n


def order_statistics(values: DataFrame, probs: list[float]) -> list[float]:
    """Quantiles (linear between neighbours) of the values ``x``, each taken ``n`` times; none of an empty table.

    The values are dealt by ranges; the driver gets a count per range, finds the ranges and places of the wanted
    ranks and asks for these values alone. No task sees more than its range, at any size."""
    from pyspark import StorageLevel

    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = values.where("x IS NOT NULL").select("x", F.col("n").cast("long").alias("n")).repartitionByRange(parts, "x").sortWithinPartitions("x")
    dealt = dealt.withColumn("part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r.part: r.total for r in dealt.groupBy("part").agg(F.sum("n").alias("total")).collect()}
        total, begin = 0, {}
        for part in sorted(sizes):
            begin[part] = total
            total += sizes[part]
        if not total:
            return []
        at = [min(max(p, 0.0), 1.0) * (total - 1) for p in probs]
        ranks = sorted({r for a in at for r in (math.floor(a), math.ceil(a))})

        def pick(batches):
            wanted, before = None, 0
            for b in batches:
                if not b.num_rows:
                    continue
                if wanted is None:
                    before = begin[b.column(2)[0].as_py()]
                    wanted = ranks
                ends = before + np.cumsum(b.column(1).to_numpy())
                here = [r for r in wanted if before <= r < ends[-1]]
                if here:
                    found = b.column(0).take(pa.array(np.searchsorted(ends, here, "right")))
                    yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), found], ["rank", "x"])
                before = int(ends[-1])

        found = {r["rank"]: r.x for r in dealt.mapInArrow(pick, "rank long, x double").collect()}
    finally:
        dealt.unpersist()
    out = []
    for a in at:
        lo, hi = math.floor(a), math.ceil(a)
        out.append(found[lo] if lo == hi else (hi - a) * found[lo] + (a - lo) * found[hi])
    return out


def _add(total: dict[str, np.ndarray], more: dict[str, np.ndarray]) -> None:
    for k, v in more.items():
        v = np.asarray(v, float)
        if k not in total:
            total[k] = v.copy()
        elif k.startswith("max_"):
            total[k] = np.maximum(total[k], v)
        else:
            total[k] += v


def validate(df: DataFrame, columns: list[str], numeric: list[str], na_action: str = "fail") -> tuple[DataFrame, int, dict]:
    """One job: the number of rows, bad values and ranges of the numeric columns. na_action: fail or drop."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in the table; it has {df.columns}")
    kinds = dict(df.dtypes)
    for c in numeric:
        if kinds[c] in ("string", "binary", "boolean") or kinds[c].startswith(("array", "map", "struct")):
            raise TypeError(f"{c} must be numeric, is {kinds[c]}")
    narrow = df.select(*[(F.col(f"`{c}`").cast("double") if c in numeric else F.col(f"`{c}`")).alias(c) for c in columns])
    bad = {c: (F.col(f"`{c}`").isNull() | (F.isnan(F.col(f"`{c}`")) | (F.abs(F.col(f"`{c}`")) == float("inf")) if c in numeric else F.lit(False))) for c in columns}
    if na_action == "drop":
        for b in bad.values():
            narrow = narrow.where(~b)
    r = narrow.agg(F.count(F.lit(1)).alias("n"), *[F.sum(b.cast("long")).alias(f"bad_{i}") for i, b in enumerate(bad.values())], *[f(F.col(f"`{c}`")).alias(f"{g}_{i}") for i, c in enumerate(numeric) for f, g in ((F.min, "lo"), (F.max, "hi"))]).first()
    if not r.n:
        raise ValueError("the table has no rows")
    found = {c: r[f"bad_{i}"] for i, c in enumerate(columns) if r[f"bad_{i}"]}
    if found:
        raise ValueError(f"null, NaN or infinite values: {found}; na_action='drop' leaves such rows out")
    return narrow, r.n, {c: (r[f"lo_{i}"], r[f"hi_{i}"]) for i, c in enumerate(numeric)}


def collect_columns(df: DataFrame) -> Columns:
    return to_columns(df.toArrow())


def rows_of(df: DataFrame, n: int, local: int | None = None) -> LocalRows | SparkRows:
    """The table as rows: local if it has few (counted) rows, else persisted on the cluster."""
    if n <= (LOCAL if local is None else local):
        return LocalRows(collect_columns(df))
    from pyspark import StorageLevel

    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    return SparkRows(kept, n, (kept,))


def spark_type(v) -> T.DataType:
    return T.StringType() if isinstance(v, str) else T.LongType() if isinstance(v, (int, np.integer)) else T.DoubleType()
