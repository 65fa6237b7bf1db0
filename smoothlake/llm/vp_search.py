"""Nearest neighbours by cosine with one vantage-point tree per shard.

Unit vectors make the chord a metric in which cosine order is distance order. Each task holds one shard of
the candidates, builds its tree and runs all queries through it, block by block from a table in the shared
folder; the shards' best are merged. A subtree is left out if the triangle inequality, with the radius of
the current neighbours times ``factor`` and a margin for rounding, excludes it: factor one is exact, smaller ones
visit fewer leaves. Distances only prune: what a leaf holds is ranked by the cosine itself, computed one way for all
pairs, so neighbours that differ in the last digits come in the order of their scores, and by id where these are equal.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
with a null id; vectors of equal direction are one point of the tree with its smallest ids (as many as can be
asked for); points follow their smallest ids and ties go to the smaller id; a repeated id is a candidate like any
other, but never of a query with that id; query rows with one id and different vectors are searched and ranked each for
itself, equal ones once. A vector of another length than the commonest (the shorter, of two that are as common) has no
cosine with the others and takes no part. With fewer candidates than k all are returned; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import file_system, shared_dir, tune


@dataclass(frozen=True)
class SearchOptions:
    """factor: of the radius in the pruning test (1: exact). shard: expected vectors of a shard. leaf: of a
    leaf. block: queries searched at once."""

    k: int = 5
    factor: float = 1.0
    shard: int = 65_536
    leaf: int = 256
    block: int = 4096


#: By how much a computed chord may be off (the root of a rounding error near zero, on either side), and a cosine.
CHORD_ERROR, COSINE_ERROR = 1e-7, 1e-13


class VantageTree:
    """A tree over distinct directions. ``points``: the vectors as given, in the order in which ties are broken."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.raw, self.leaf = points, leaf
        self.norms = np.sqrt(np.einsum("ij,ij->i", points, points))
        self.points = points / self.norms[:, None]
        self.root = self._build(np.arange(len(points)), np.random.default_rng(4))

    def _build(self, at: np.ndarray, rng):
        if len(at) <= self.leaf:
            return (at, np.ascontiguousarray(self.points[at].T))
        v = self.points[at[rng.integers(len(at))]]
        d = chord(self.points[at] @ v)
        mu = float(np.median(d))
        inside = d < mu
        if not inside.any() or inside.all():  # all as far away: no vantage point tells them apart
            inside = np.arange(len(at)) < len(at) // 2
            return (v, None, self._build(at[inside], rng), self._build(at[~inside], rng))
        return (v, mu, self._build(at[inside], rng), self._build(at[~inside], rng))

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, points) of the k nearest of each query, nearest first; -inf and -1 where there are fewer."""
        self.queries, self.lengths = queries, np.sqrt(np.einsum("ij,ij->i", queries, queries))
        self.best = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1)
        self._visit(self.root, np.arange(len(queries)), queries / self.lengths[:, None], factor)
        return self.best, self.found

    def _rank(self, who: np.ndarray, at: np.ndarray, near: np.ndarray) -> None:
        """Takes into the neighbours of ``who`` what may belong there of a leaf's points, given rough cosines."""
        k = self.best.shape[1]
        floor = self.best[who, -1]
        if near.shape[1] > k:
            floor = np.maximum(floor, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k])
        r, c = np.nonzero(near >= (floor - COSINE_ERROR)[:, None])
        for lo in range(0, len(r), 1 << 17):  # whole queries may be parted: what is found is kept
            q, p = who[r[lo : lo + (1 << 17)]], at[c[lo : lo + (1 << 17)]]
            score = np.einsum("ij,ij->i", self.raw[p], self.queries[q]) / (self.norms[p] * self.lengths[q])
            some = np.unique(q)
            q = np.concatenate([q, np.repeat(some, k)])
            p = np.concatenate([p, self.found[some].ravel()])
            score = np.concatenate([score, self.best[some].ravel()])
            order = np.lexsort((p, -score, q))
            q, p, score = q[order], p[order], score[order]
            place = np.arange(len(q)) - np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))[np.searchsorted(some, q)]
            top = place < k
            self.best[q[top], place[top]], self.found[q[top], place[top]] = score[top], p[top]

    def _visit(self, node, who: np.ndarray, q: np.ndarray, factor: float) -> None:
        if not len(who):
            return
        if len(node) == 2:
            self._rank(who, node[0], q[who] @ node[1])
            return
        v, mu, inside, outside = node
        if mu is None:
            self._visit(inside, who, q, factor)
            self._visit(outside, who, q, factor)
            return
        d = chord(q[who] @ v)
        near = d < mu
        a, b = who[near], who[~near]
        self._visit(inside, a, q, factor)
        self._visit(outside, b, q, factor)
        reach = factor * chord(self.best[who, -1]) + CHORD_ERROR
        self._visit(outside, who[near & (mu - d <= reach)], q, factor)
        self._visit(inside, who[~near & (d - mu <= reach)], q, factor)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def _usable(vectors: DataFrame, dims: int) -> DataFrame:
    v = F.col("vector")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(ok & F.exists(v, lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)


def search(vectors: DataFrame, is_query, options: SearchOptions = SearchOptions(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest candidates of each row that fulfils ``is_query``."""
    spark = vectors.sparkSession
    tune(spark)
    o = options
    narrow = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    found = narrow.where("vector is not null").groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not found or not found[0].dims:
        return spark.createDataFrame([], schema)
    rows = _usable(narrow, found[0].dims)
    place = shared_dir(spark, "queries")
    rows.where(is_query).dropDuplicates(["vec_id", "vector"]).withColumn("mark", F.xxhash64("vector")).write.parquet(place)
    shards = max(1, -(-found[0]["count"] // o.shard))
    k = o.k

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        ids, raw = t.column("vec_id").to_numpy(), _matrix(t.column("vector"))
        order = np.lexsort((ids,))
        ids, raw = ids[order], raw[order]
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True) + 0.0  # no negative zeros
        keys = unit.view([("", unit.dtype)] * unit.shape[1]).ravel()
        _, first, same = np.unique(keys, return_index=True, return_inverse=True)
        by_id = np.argsort(first)  # rows are sorted by id
        first, same = first[by_id], np.argsort(by_id)[same]
        by_point = np.argsort(same, kind="stable")
        begin = np.concatenate(([0], np.cumsum(np.bincount(same, minlength=len(first)))))
        tree = VantageTree(raw[first], o.leaf)
        fs, folder = file_system(place)
        for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda x: x.path):
            if not info.path.endswith(".parquet"):
                continue
            with fs.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f).iter_batches(batch_size=o.block):
                    qid, q, mark = b.column("vec_id").to_numpy(), _matrix(b.column("vector")), b.column("mark").to_numpy()
                    # one more than k: the query's own vector may be a point with no other id
                    scores, near = tree.search(q, k + 1, o.factor)
                    out: list[tuple[int, int, int, float]] = []
                    for r in range(len(q)):
                        hits = []
                        for point, s in zip(near[r].tolist(), scores[r].tolist(), strict=True):
                            if point >= 0:
                                own = ids[by_point[begin[point] : begin[point + 1]]]
                                hits += [(-s, int(x)) for x in own[own != qid[r]][:k]]
                        out += [(int(qid[r]), int(mark[r]), x, -s) for s, x in sorted(hits)[:k]]
                    if out:
                        c = list(zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.float64())], ["query_id", "mark", "vec_id", "score"])

    best = rows.repartition(shards, F.xxhash64("vec_id")).mapInArrow(run, "query_id long, mark long, vec_id long, score double")
    w = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
