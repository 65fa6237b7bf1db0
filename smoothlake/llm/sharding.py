"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of positions. A key belongs to the next virtual node clockwise; a key whose
shard is full continues clockwise to the next node of a shard with room. Rows of one position are ranked
in parallel, only the counts per position reach the driver, which settles the overflow on counts; each row
finds its shard by its position and rank. With capacities that sum to the number of rows (factor 1) the
shards' row counts differ by one at most; a larger factor moves fewer rows.

Edge cases: a null id is dealt by its text's checksum; repeated rows, which share a position, are placed one by one
(under the law ``rows`` a third of all rows cannot stay in one shard, so equal texts are not kept together); rows of one
position with equal checksums are told apart by no property and take its places in any order; very long texts are one
row like others; a null text has size 1 and checksum 0; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POSITIONS = 1 << 16


@dataclass(frozen=True)
class ShardOptions:
    """shards, virtual_nodes per shard; factor: a shard takes at most factor times the mean number of rows
    (1: counts are at most one apart)."""

    shards: int = 8
    virtual_nodes: int = 128
    factor: float = 1.0


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, shard) of the virtual nodes, clockwise; a node's position depends on its shard alone."""
    nodes = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") >> 48, s) for s in range(shards) for v in range(virtual_nodes))
    return np.array([p for p, _ in nodes]), np.array([s for _, s in nodes])


def settle(counts: dict[int, int], o: ShardOptions) -> list[tuple[int, int, int, int, int]]:
    """(position, first rank, end rank, shard, slot of the first): who takes which ranks of each position.

    Round by round, every shard takes what has arrived at its nodes in clockwise order while it has room;
    what is left moves on to the next node.
    """
    at, owner = ring(o.shards, o.virtual_nodes)
    total = sum(counts.values())
    if o.factor <= 1:
        room = [total // o.shards + (s < total % o.shards) for s in range(o.shards)]
    else:
        room = [int(-(-o.factor * total // o.shards))] * o.shards
    used = [0] * o.shards
    waiting = deque((int(np.searchsorted(at, p)) % len(at), p, 0, n) for p, n in sorted(counts.items()))
    out = []
    while waiting:
        moving: deque = deque()
        for node, p, lo, hi in waiting:
            s = int(owner[node])
            take = min(hi - lo, room[s] - used[s])
            if take > 0:
                out.append((p, lo, lo + take, s, used[s]))
                used[s] += take
            if lo + max(take, 0) < hi:
                step = node
                while used[int(owner[step])] >= room[int(owner[step])]:
                    step = (step + 1) % len(at)
                moving.append((step, p, lo + max(take, 0), hi))
        waiting = deque(sorted(moving))
    return out


def place(documents: DataFrame, options: ShardOptions = ShardOptions()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``documents``."""
    spark = documents.sparkSession
    o = options
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.col("text_crc32")), F.lit("ring"))
    keyed = narrow.withColumn("position", F.shiftrightunsigned(key, 48).cast("int"))
    counts = {p: n for p, n in keyed.groupBy("position").count().collect()}  # a row per ring position at most
    takes = settle(counts, o)
    order = Window.partitionBy("position").orderBy("doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    table = spark.createDataFrame(takes, "position int, lo long, hi long, shard int, base long")
    placed = ranked.join(F.broadcast(table), "position").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows" if o.factor <= 1 else "bounded").alias("law"), "shard",
        (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
