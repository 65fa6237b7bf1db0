"""Near duplicates by order min-hashing of occurrence-labelled word k-mers, verified by banded alignment.

A text's k-mers are its runs of ``k`` words, each labelled with how often it has occurred before, so every
labelled k-mer is unique in its text. One sketch holds the ``sample`` k-mers of smallest hash, kept in text
order: two texts share it with a probability that falls with their edit distance. Texts that share a sketch
meet in a bucket. The bucket's most connected text is its leader, and the others are aligned with it alone;
after components are formed, only buckets that still hold several components are looked at again, block by
block: there every pair across components whose signatures and common k-mers allow the threshold is aligned
until its components are joined, so no link between different components goes untested however large the
bucket is, and a group of near copies costs links in proportion to its texts.

Alignment: labelled k-mers match at most once in either text, so the longest common subsequence is the
longest increasing run of matched positions, within a band around the diagonal. With L common k-mers in
order, similarity is L / (n1 + n2 - L).

Edge cases: equal texts (rows repeated or not) form one class without any pairs; texts with fewer words
than ``k`` are one k-mer of all their words; null texts and texts without a word form classes of their own
per row and are never linked; very long texts are sketched and aligned whole. Of ties (equal ids, equal texts) the
smallest row in all columns is kept. An empty table gives an empty table. Extra columns are ignored or carried.

A bucket of any size is dealt over ``spread`` tasks for its joins and over blocks for comparisons.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, lots, mix, staged, tune
from .components import components



@dataclass(frozen=True)
class DedupOptions:
    """k: words of a shingle. sketches: independent order min-hashes. sample: k-mers kept by each.
    similarity: the least similarity of a link. bins: bytes of the signature that decides which pairs of a
    mixed bucket are aligned. block, kmers: texts, and k-mers of texts, of one bucket that a task compares with
    another block at once (in expectation). spread: parts into which the rows of every bucket are dealt."""

    k: int = 5
    sketches: int = 16
    sample: int = 3
    similarity: float = 0.8
    bins: int = 128
    block: int = 1024
    kmers: int = 1 << 20
    spread: int = 64


def kmer_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers in text order."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    h = mix(h + np.uint64(k))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.flatnonzero(s[1:] == s[:-1]) + 1
    if len(same):
        label = np.zeros(n, np.uint64)
        run = np.arange(n)
        starts = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))
        label[order] = (run - np.repeat(starts, np.diff(np.concatenate((starts, [n]))))).astype(np.uint64)
        repeated = label > 0
        h[repeated] = mix(h[repeated] + label[repeated] * np.uint64(0xD6E8FEB86659FD93))
    return h


def _multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return seeds[:m] | np.uint64(1), seeds[m:]


def order_sketches(h: np.ndarray, sketches: int, sample: int) -> np.ndarray:
    """One key per sketch: the sampled k-mers in text order."""
    a, b = _multipliers(sketches)
    n = len(h)
    take = min(sample, n)
    picked = np.empty((sketches, take), np.uint64)
    for i in range(sketches):
        v = (h ^ b[i]) * a[i]
        v ^= v >> np.uint64(29)
        picked[i] = h[np.sort(np.argpartition(v, take - 1)[:take])] if take < n else h
    keys = np.arange(1, sketches + 1, dtype=np.uint64)
    for column in picked.T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def signature(h: np.ndarray, bins: int) -> bytes:
    """One byte per bin of the hash range: of the bin's smallest k-mer, 0 where the bin is empty."""
    width = np.uint64(64 - (bins - 1).bit_length())
    s = np.sort(h)
    where = (s >> width).astype(np.int64)
    first = np.concatenate(([True], where[1:] != where[:-1]))
    out = np.zeros(bins, np.uint8)
    out[where[first]] = (mix(s[first]) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    return out.tobytes()


def aligned(x: np.ndarray, y: np.ndarray, similarity: float) -> float:
    """Similarity by banded alignment of two rows of labelled k-mers; 0 where the lengths rule a link out."""
    n, m = len(x), len(y)
    if min(n, m) < similarity * max(n, m):
        return 0.0
    both, i, j = np.intersect1d(x, y, assume_unique=False, return_indices=True)
    if len(both) < similarity / (1 + similarity) * (n + m) - 1e-9:
        return len(both) / (n + m - len(both)) if len(both) else 0.0
    band = int((1 - similarity) * (n + m)) + 1
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    tails: list[int] = []
    for p in j[np.argsort(i)].tolist():
        at = bisect_left(tails, p)
        if at == len(tails):
            tails.append(p)
        else:
            tails[at] = p
    return len(tails) / (n + m - len(tails))


def _words(hashes: WordHashes, texts: list[str]):
    """The hashes of each text's words."""
    for lo, hi in lots(texts):
        h, begin = hashes(texts[lo:hi])
        yield from np.split(h, begin[1:-1])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.withColumn("node", F.unhex(F.md5(F.col("text"))))


def _sketched(texts: DataFrame, o: DedupOptions) -> DataFrame:
    """(node, n, keys, sig) of every text with a word."""
    out = pa.schema([("node", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            rows = [[], [], [], []]
            for node, words in zip(b.column("node").to_pylist(), _words(hashes, b.column("text").to_pylist()), strict=True):
                h = kmer_hashes(words, o.k)
                if len(h):
                    for to, v in zip(rows, (node, len(h), order_sketches(h, o.sketches, o.sample).view(np.int64).tolist(), signature(h, o.bins)), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(r, t.type) for r, t in zip(rows, out, strict=True)], schema=out)

    return texts.mapInArrow(run, "node binary, n int, keys array<bigint>, sig binary")


def _kmers(texts: DataFrame, o: DedupOptions) -> DataFrame:
    """(node, h): 32-bit labelled k-mers, for alignment."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            h = [(kmer_hashes(words, o.k) >> np.uint64(32)).astype("<u4").tobytes() for words in _words(hashes, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(h, pa.binary())], ["node", "h"])

    return texts.mapInArrow(run, "node binary, h binary")


def _aligned(pairs: DataFrame, kmers: DataFrame, o: DedupOptions) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the threshold."""
    left = kmers.select(F.col("node").alias("a"), F.col("h").alias("ha"))
    right = kmers.select(F.col("node").alias("b"), F.col("h").alias("hb"))
    least = o.similarity

    def run(batches):
        for b in batches:
            found = [
                aligned(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least)
                for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist(), strict=True)
            ]
            out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])
            yield out.filter(pa.array([v >= least for v in found], pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a binary, b binary, similarity double")


def _part(o: DedupOptions):
    """Which part of its buckets a text belongs to: joins on (key, part) deal the rows of a large bucket over tasks."""
    return F.pmod(F.xxhash64("node"), F.lit(o.spread)).cast("int")


def _buckets(keyed: DataFrame, o: DedupOptions) -> tuple[DataFrame, DataFrame]:
    """((node, key, part, size) of the texts that share a key, (key, part) of their parts)."""
    keyed = keyed.withColumn("part", _part(o))
    counts = keyed.groupBy("key", "part").agg(F.count("*").alias("rows"))
    sizes = counts.groupBy("key").agg(F.sum("rows").alias("size")).where("size > 1")
    parts = staged(counts.select("key", "part").join(sizes, "key"), "parts")  # a key has at most ``spread`` rows here
    return staged(keyed.join(parts, ["key", "part"]).select("node", "key", "part", "size"), "buckets"), parts.select("key", "part")


def _star_pairs(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """Each member with its bucket's leader: the text whose buckets are largest in sum, the smallest node among equals."""
    degree = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    members = shared.join(degree, "node")
    leaders = members.groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("leader"))
    near = parts.join(leaders, "key")
    return shared.join(near, ["key", "part"]).where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _groups(batches, names: list[str], key: list[str]):
    """Lists of the columns ``names`` for each run of equal ``key`` columns in sorted batches."""
    held: list[list] = [[] for _ in names]
    current = None
    for b in batches:
        columns = [b.column(n).to_pylist() for n in names]
        keys = list(zip(*(b.column(n).to_pylist() for n in key), strict=True))
        begin = 0
        for i, k in enumerate(keys):
            if k != current:
                for h, c in zip(held, columns, strict=True):
                    h += c[begin:i]
                if current is not None:
                    yield current, held
                held, current, begin = [[] for _ in names], k, i
        for h, c in zip(held, columns, strict=True):
            h += c[begin:]
    if current is not None:
        yield current, held


def _met(rows: DataFrame, o: DedupOptions) -> DataFrame:
    """A bucket's rows dealt into blocks, each repeated for the blocks it meets: a block meets itself and, once,
    every other block of its bucket, so that no task needs a whole bucket. Sorted by (key, lo, hi).

    ``size`` is the number of k-mers to be held of a bucket, 0 where none are."""
    blocks = F.ceil(F.greatest(F.col("rows") / o.block, F.col("size") / o.kmers)).cast("int")
    dealt = rows.withColumn("blocks", F.greatest(blocks, F.lit(1))).drop("size").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("blocks", "other")
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")


def _plausible(mixed: DataFrame, o: DedupOptions) -> DataFrame:
    """(key, node): the members of mixed buckets that some member of another component may be linked with, as
    far as lengths and signatures tell."""
    least, bins = o.similarity, o.bins
    names = ["node", "label", "n", "sig", "mine"]

    def run(batches):
        for (key, lo, hi), (node, label, n, sig, mine) in _groups(batches, names, ["key", "lo", "hi"]):
            if len(node) < 2:
                continue
            codes = np.unique(np.array([x.hex() for x in label]), return_inverse=True)[1]
            sig = np.frombuffer(b"".join(sig), np.uint8).reshape(len(node), bins)
            n, mine = np.array(n), np.array(mine)
            there = sig > 0
            keep = np.zeros(len(node), bool)
            for i in np.flatnonzero(mine == lo) if lo != hi else range(len(node) - 1):
                js = np.flatnonzero(mine == hi) if lo != hi else np.arange(i + 1, len(node))
                js = js[(codes[js] != codes[i]) & (np.minimum(n[js], n[i]) >= least * np.maximum(n[js], n[i]))]
                if len(js):
                    used = (there[js] | there[i]).sum(axis=1)
                    agree = ((sig[js] == sig[i]) & there[i]).sum(axis=1)
                    js = js[agree >= (least - 5 * np.sqrt(least * (1 - least) / np.maximum(used, 1))) * used]
                    keep[js] = True
                    keep[i] |= len(js) > 0
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array([node[i] for i in at], pa.binary())], ["key", "node"])

    return _met(mixed.withColumn("size", F.lit(0)), o).select("key", "lo", "hi", *names).mapInArrow(run, "key long, node binary").distinct()


def overlaps(kmers: list[np.ndarray]) -> np.ndarray:
    """Numbers of common k-mers of all pairs of texts, as products of incidence matrices over the k-mers that
    several of them have."""
    sizes = [len(x) for x in kmers]
    row = np.repeat(np.arange(len(kmers)), sizes)
    _, col, count = np.unique(np.concatenate(kmers), return_inverse=True, return_counts=True)
    common = count > 1
    number = np.cumsum(common) - 1
    use = common[col]
    row, col = row[use], number[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(kmers), len(kmers)), np.float32)
    step = 2048
    for lo in range(0, int(common.sum()), step):
        a, b = np.searchsorted(col, [lo, lo + step])
        m = np.zeros((len(kmers), step), np.float32)
        m[row[a:b], col[a:b] - lo] = 1.0
        total += m @ m.T
    return total


def _mixed_links(shared: DataFrame, parts: DataFrame, labels: DataFrame, sketched: DataFrame, kmers: DataFrame, o: DedupOptions) -> DataFrame:
    """(a, b, similarity): links that join different components within buckets.

    All pairs of a block are compared by their common k-mers; pairs that reach the threshold are aligned, unless
    their components have been joined before, so a group of many near copies gives a link per text, not per pair.
    """
    placed = shared.select("node", "key", "part").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).where("low <> high").select("key", "rows")
    mixed = placed.join(parts.join(sizes, "key"), ["key", "part"]).join(sketched.select("node", "n", "sig"), "node")
    chosen = staged(_plausible(mixed.select("key", "rows", "node", "label", "n", "sig"), o).withColumn("part", _part(o)), "plausible")
    # equal sets of members meet in several buckets: one of these buckets is enough
    member = F.xxhash64("node")
    chosen = chosen.join(sketched.select("node", "n"), "node")
    sets = chosen.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("size"), F.sum(member.cast("decimal(38,0)")).alias("s"), F.bit_xor(member).alias("x"))
    once = sets.where("rows > 1").groupBy("rows", "size", "s", "x").agg(F.min("key").alias("key")).select("key", "rows", "size")
    rows = chosen.drop("n").join(parts.join(once, "key"), ["key", "part"]).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(kmers, "node")
    least = o.similarity
    names = ["node", "label", "h", "mine"]

    def run(batches):
        for (_, lo, hi), (node, label, h, mine) in _groups(batches, names, ["key", "lo", "hi"]):
            if len(node) < 2:
                continue
            x = [np.frombuffer(v, "<u4") for v in h]
            n, mine = np.array([len(v) for v in x]), np.array(mine)
            common = overlaps(x)
            near = common >= least / (1 + least) * (n[:, None] + n) - 1e-3
            parent = {v: v for v in label}

            def root(v):
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v

            out = []
            for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
                if (lo != hi and mine[i] == mine[j]) or (r := root(label[i])) == (q := root(label[j])):
                    continue
                similarity = aligned(x[i], x[j], least)
                if similarity >= least:
                    parent[max(r, q)] = min(r, q)
                    out.append((min(node[i], node[j]), max(node[i], node[j]), similarity))
            if out:
                a, b, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(v, pa.float64())], ["a", "b", "similarity"])

    return _met(rows.select("key", "rows", "size", "node", "label", "h"), o).select("key", "lo", "hi", *names).mapInArrow(run, "a binary, b binary, similarity double").dropDuplicates(["a", "b"])


def near_classes(documents: DataFrame, options: DedupOptions = DedupOptions()) -> tuple[DataFrame, DataFrame]:
    """(labels, links): ``node, label`` of every text that has a link, and ``a, b, similarity`` of the links
    found. A node is the 16-byte MD5 of a text."""
    spark = documents.sparkSession
    tune(spark)
    o = options
    texts = _texts(documents.select("text").where(F.col("text").isNotNull()))
    # copies are sketched where they lie, so that sketches, not texts, are shuffled to drop them
    sketched = staged(_sketched(texts, o).dropDuplicates(["node"]), "sketches")
    keyed = sketched.select("node", F.explode("keys").alias("key"))
    shared, parts = _buckets(keyed, o)
    near = shared.select("node").distinct()
    # copies go before the texts are shuffled
    distinct = texts.groupBy("node").agg(F.first("text").alias("text"))
    kmers = staged(_kmers(distinct.join(near, "node", "left_semi"), o), "kmers")
    links = staged(_aligned(_star_pairs(shared, parts), kmers, o), "links")
    labels = components(links)
    more = staged(_mixed_links(shared, parts, labels, sketched, kmers, o), "links")
    if more.limit(1).count():
        links = links.unionByName(more)
        labels = components(links)
    return labels, links


def near_duplicates(documents: DataFrame, options: DedupOptions = DedupOptions()) -> DataFrame:
    """doc_id, class_id, keep, links: one row per row of ``documents``.

    class_id is the smallest doc_id of the class; keep marks the one row of it that a corpus retains (the
    smallest doc_id's, one row where that is repeated); links counts the links to different texts that were needed to form the class.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels, links = near_classes(rows, options)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    row = F.monotonically_increasing_id()
    # a text without a word is a class of its own, row by row
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[\p{L}\p{N}]")
    placed = staged(
        _texts(rows).withColumn("row", row).withColumn("alone", wordless)
        .withColumn("node", F.when(F.col("alone"), F.unhex(F.md5(F.concat(F.lit("row "), F.col("row").cast("string"))))).otherwise(F.col("node")))
        .select("doc_id", "row", "node"),
        "rows",
    )
    known = labels.join(degree, "node", "left")
    placed = placed.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = placed.groupBy("label").agg(F.min_by(F.struct("doc_id", "row"), F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head"))
    return placed.join(heads, "label").select("doc_id", F.col("head.doc_id").alias("class_id"), (F.col("row") == F.col("head.row")).alias("keep"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def keep_first(documents: DataFrame, options: DedupOptions = DedupOptions()) -> DataFrame:
    """One document of each class, with all its columns: of the smallest id, of equal ids the smallest text."""
    labels, _ = near_classes(documents, options)
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[\p{L}\p{N}]")
    marked = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"), "doc_id", F.unhex(F.md5("text")).alias("node"), wordless.alias("alone"))
    alone = marked.where("alone").select("doc.*")
    rows = marked.where("not alone")
    narrow = rows.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("node").alias("node"))
    heads = narrow.groupBy("label").agg(F.min(ids).alias("head")).select(F.col("head.node").alias("node"), F.col("head.doc_id").alias("doc_id"))
    # whole documents are dealt by text and id; equal rows of one id are one document, too: the least of them in all
    # columns that have an order
    kept = rows.withColumn("doc_id", F.col("doc.doc_id")).alias("r").join(heads.alias("h"), (F.col("r.node") == F.col("h.node")) & F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")), "left_semi")
    return alone.unionByName(kept.groupBy("node").agg(_least(documents).alias("doc")).select("doc.*"))


def _least(documents: DataFrame):
    """The struct ``doc`` that is smallest, or, with a column of a type without order, any."""
    maps = any("map<" in t or t == "variant" for _, t in documents.dtypes)
    return F.first("doc") if maps else F.min("doc")
