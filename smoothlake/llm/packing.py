"""Best-fit packing of tokenised documents into sequences, with certified bin counts.

Documents become pieces (only documents longer than a sequence are cut). Pieces are dealt to partitions;
each partition packs best-fit decreasing and compares its number of bins with lower bounds from
dual-feasible functions. A certified partition gives up its few emptiest bins only, a partition with a gap
more of them; the pieces given up are exchanged between fewer partitions, level by level, and packed again
until one partition is left or the bins in all meet the bound of the whole.

Edge cases: a null or empty text is its end id alone; repeated rows are packed row by row; ties in length go
by row; an empty table gives no sequences; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged, tune
from .tokens import crc, default_tokenizer, encoder


@dataclass(frozen=True)
class PackingOptions:
    """capacity: tokens of a sequence. end_id: appended to each document. pieces: expected pieces of a
    partition. fold: partitions whose exchanged pieces meet at the next level. spare: emptiest bins that even
    a certified partition gives up."""

    tokenizer: str | None = None
    capacity: int = 4096
    end_id: int = 1
    pieces: int = 200_000
    fold: int = 16
    spare: int = 8


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of several dual-feasible functions, from counts by length.

    Continuous bound; thresholds t (lengths over capacity - t fill a bin, those under t weigh nothing);
    and the rounding functions x -> floor((k+1) x / capacity) / k for k up to 30, exact multiples kept.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    n = histogram.astype(np.int64)
    weight = n * x
    best = -(-int(weight.sum()) // capacity)
    count, mass = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(weight)))
    t = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - t + 1]
    middle = mass[capacity - t + 1] - mass[t]
    if len(t):
        best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 31):
        whole = (k + 1) * x % capacity == 0
        # in units of 1 / (k * capacity), so that all stays integral
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, and the residual capacity of each bin. Open bins are kept by residual;
    a bit per residual finds the tightest that still fits."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits = 0
    residual: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_bits >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = stacks[r].pop()
            if not stacks[r]:
                open_bits &= ~(1 << r)
        else:
            b, r = len(residual), capacity
            residual.append(capacity)
        where[i], offset[i] = b, capacity - r
        r -= size
        residual[b] = r
        if r:
            stacks[r].append(b)
            open_bits |= 1 << r
    return where, offset, np.array(residual, np.int64)


def pieces_of(documents: DataFrame, options: PackingOptions = PackingOptions(), with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for): the pieces of all documents."""
    tune(documents.sparkSession)
    o = options
    path = o.tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        encode = encoder(path, 200_000, 100_000)  # beside what other stages of a pipeline keep in the same worker
        end = np.array([o.end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text) + end
                for k, lo in enumerate(range(0, len(ids), 4 * o.capacity)):
                    part = ids[lo : lo + 4 * o.capacity]
                    rows.append((doc, k, lo // 4, len(part) // 4, crc(part)) + ((part,) if with_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=False)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _packed(items: DataFrame, level: int, partitions: int, o: PackingOptions) -> DataFrame:
    """(uid, length, sequence_id, offset, open): one level. open: the piece goes on to the next level."""
    last = partitions == 1

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        uid, lengths = t.column("uid").to_numpy(), t.column("length").to_numpy()
        order = np.argsort(uid)
        uid, lengths = uid[order], lengths[order]
        where, offset, residual = best_fit_decreasing(lengths, o.capacity)
        bound = lower_bound(np.bincount(lengths, minlength=o.capacity + 1), o.capacity)
        released = np.zeros(len(residual), bool)
        if not last:
            give = o.spare * (1 + len(residual) - bound)
            emptiest = np.argsort(-residual, kind="stable")[:give]
            # beyond the spare bins no more pieces than make ``fold`` partitions' a partition of the next level
            emptiest = emptiest[(np.arange(len(emptiest)) < o.spare) | (np.cumsum(np.bincount(where)[emptiest]) <= o.pieces // o.fold)]
            released[emptiest[residual[emptiest] > 0]] = True
        base = (level << 54) | (TaskContext.get().partitionId() << 32)
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(lengths), pa.array(where + base), pa.array(offset), pa.array(released[where])], ["uid", "length", "sequence_id", "offset", "open"])

    dealt = items.select("uid", "length").repartition(partitions, F.xxhash64("uid")) if not last else items.select("uid", "length").coalesce(1)
    return dealt.mapInArrow(run, "uid long, length long, sequence_id long, offset long, open boolean")


def pack(documents: DataFrame, options: PackingOptions = PackingOptions()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document, placed."""
    o = options
    pieces = staged(pieces_of(documents, o).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    histogram = np.zeros(o.capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # a row per length at most
        histogram[length] = n
    bound = lower_bound(histogram, o.capacity)
    partitions = max(1, -(-int(histogram.sum()) // o.pieces))
    placed, level, items, closed = None, 0, pieces, 0
    while True:
        done = staged(_packed(items, level, partitions, o), "packed")
        bins, going = done.select(F.countDistinct("sequence_id"), F.countDistinct(F.when(F.col("open"), F.col("sequence_id")))).first()
        finished = partitions == 1 or not going or closed + bins == bound
        part = done if finished else done.where("not open")
        placed = part if placed is None else placed.unionByName(part)
        if finished:
            break
        closed += bins - going
        items, level, partitions = done.where("open"), level + 1, -(-partitions // o.fold)
    return pieces.join(placed.select("uid", "sequence_id", "offset"), "uid").drop("uid")
