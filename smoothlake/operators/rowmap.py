"""Row maps: columns added to a table from blocks of its rows, in one narrow stage without a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smoothlake.sources.rows import to_columns


def add_columns(df: DataFrame, needed: list[str], f, names: list[str], numeric: set[str] | None = None) -> DataFrame:
    """``df`` with the double columns ``names`` (or arrays of doubles where a name ends in ``[]``) that ``f``
    returns for a block. Rows with a null in a needed column get nulls. Only a needed column reaches the
    scan beside those of ``df`` that the caller keeps."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in the table; it has {df.columns}")
    taken = [n for n in names if n.removesuffix("[]") in df.columns]
    if taken:
        raise ValueError(f"the table already has columns {taken}")
    kinds = dict(df.dtypes)
    aside = [f"__in_{i}" for i in range(len(needed))]
    typed = [(F.col(f"`{c}`") if kinds[c] in ("string", "boolean") or (numeric is not None and c not in numeric) else F.col(f"`{c}`").cast("double")).alias(a) for c, a in zip(needed, aside, strict=True)]
    wide = df.select("*", *typed)
    fields = [T.StructField(n.removesuffix("[]"), T.ArrayType(T.DoubleType()) if n.endswith("[]") else T.DoubleType()) for n in names]
    schema = T.StructType([*df.schema.fields, *fields])
    kept = df.columns

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            bad = np.zeros(b.num_rows, bool)
            for a in aside:
                bad |= np.asarray(t.column(a).is_null().to_numpy())
            cols = {c: v for c, v in zip(needed, to_columns(t.select(aside)).values(), strict=True)}
            good = np.flatnonzero(~bad)
            if len(good) < b.num_rows:
                cols = {c: v[good] for c, v in cols.items()}
            if not needed:
                cols = {"__none": np.zeros(b.num_rows)}
            got = f(cols) if len(good) else {n: np.zeros((0, 1) if n.endswith("[]") else 0) for n in names}
            out = [t.column(i).combine_chunks() for i in range(len(kept))]
            for n in names:
                v = np.asarray(got[n], float)
                if n.endswith("[]"):
                    rows = [None] * b.num_rows
                    for i, r in zip(good, v, strict=True):
                        rows[i] = r.tolist()
                    out.append(pa.array(rows, pa.list_(pa.float64())))
                else:
                    full = np.full(b.num_rows, np.nan)
                    full[good] = v
                    out.append(pa.array(full, pa.float64(), mask=bad))
            yield pa.RecordBatch.from_arrays(out, schema=pa.schema([pa.field(x.name, a.type) for x, a in zip(schema.fields, out, strict=True)]))

    return wide.mapInArrow(run, schema)
