"""Benchmark decontamination by latent semantic retrieval and a check of the words in order.

Terms are hashed into a fixed number of columns and weighted by the inverse of the share of passages that
hold them, counted over all documents. A distributed randomised SVD of TF-IDF passages (the benchmark's items,
and with less weight those of all documents) gives a basis: every passage is added, with random signs, to a few
rows of a small matrix, whose sum over all tasks keeps the passages' common directions; its singular vectors,
together with the items', are the basis. Every window of every document is projected into it and compared with
every item by cosine, the window's length being that of the whole vector; a window whose projection is too short
for any item is not compared at all. Windows over the threshold are candidates, and the longest common subsequence
of the item's words and the words around the window decides; where only part of it is there (a paraphrase), the
item's answer, its last sentence, must be there too. An item whose words weigh so little that a verbatim copy among
the heaviest words might stay under the threshold is looked up directly: each window around which enough of
its words stand is a candidate.

A benchmark of any size is searched in lots of items, each with a basis of its own from the one sketch of the
passages. Tasks build the lots and write them to the shared folder. A worker holds a run of texts of bounded size and
takes the lots one after the other, so each lot is read once for a run; it keeps a few, and goes through them there
and back in turn.

Edge cases: null or wordless texts and items match nothing; very long texts are searched whole, in one task; ties
and repeated documents are reported row by row; items with one item_id (or without any) are one item with several
texts, of which the best match counts; empty tables give empty results; extra columns pass through where
documents are returned.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, file_system, lots, shared_dir, staged, tune

SENTENCE = re.compile(r"[.!?\n]+")
STEP = 8  # words of a block; windows are runs of blocks


@dataclass(frozen=True)
class DecontaminationOptions:
    """columns: hashed terms (a power of two). rank: of the basis. passage: words of a passage. common: natural
    logarithm of the frequency discount; terms in more than exp(-common) of the passages
    carry no weight. background: weight of the passages of all documents in the fit, as a share of the items'.
    sketch: rows of the passages' sketch. signs: rows to which a passage is added.
    part: words whose sketch a task of the fit hands on at once.
    windows: lengths in words, multiples of 16, each moved by half its length. cosine: least latent cosine of a candidate.
    verbatim: least share of the item's words in order for a match without an answer check. paraphrase:
    least share with one. answer: least share of the answer's words in order. items_per_pass: items of a lot
    (in expectation). held: lots that a worker keeps at once. run: characters of the texts that it searches together."""

    columns: int = 8192
    rank: int = 192
    passage: int = 32
    common: float = 1.0
    background: float = 0.1
    sketch: int = 256
    signs: int = 4
    part: int = 1 << 24
    windows: tuple[int, ...] = (16, 32, 64)
    cosine: float = 0.3
    verbatim: float = 0.8
    paraphrase: float = 0.6
    answer: float = 0.7
    items_per_pass: int = 224
    held: int = 4
    run: int = 1 << 24


@dataclass
class Item:
    item_id: int
    words: list[int]  # their hashes
    masks: dict[int, int]
    answer_masks: dict[int, int]
    answer_words: int


def _masks(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def common_subsequence(masks: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence, a bit per word of the first text."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def item_of(item_id: int, text: str, hashes: WordHashes) -> Item | None:
    words = hashes.of(text).tolist()
    if not words:
        return None
    answer = [s for s in (hashes.of(x).tolist() for x in SENTENCE.split(text)) if s][-1]
    return Item(item_id, words, _masks(words), _masks(answer), len(answer))


def verified(item: Item, region: list[int], o: DecontaminationOptions) -> tuple[float, bool] | None:
    """(share of the item's words found in order, whether the answer is there) of a match, else None."""
    n = len(item.words)
    # words that the region lacks cannot be in order: a bound that spares most candidates the alignment
    if sum(item.masks[w].bit_count() for w in item.masks.keys() & set(region)) < o.paraphrase * n:
        return None
    share = common_subsequence(item.masks, n, region) / n
    if share < o.paraphrase:
        return None
    answer = common_subsequence(item.answer_masks, item.answer_words, region) >= o.answer * item.answer_words
    return (share, answer) if share >= o.verbatim or answer else None


def _columns(hashes: np.ndarray, columns: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (columns - 1).bit_length())).astype(np.int64)


def passages_of(documents: DataFrame, o: DecontaminationOptions) -> DataFrame:
    """A written table of the columns of all words, two bytes each: passages of a text, the last one filled up
    with ``columns``. Words are split once for the frequencies and the fit."""
    most = max(1, (1 << 18) // o.passage) * o.passage

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            texts, rows, size = b.column("text").to_pylist(), [], 0
            for lo, hi in lots(texts):
                h, begin = hashes(texts[lo:hi])
                n = np.diff(begin)
                full = -(-n // o.passage) * o.passage
                shift = np.cumsum(full) - full - begin[:-1]
                c = np.full(full.sum(), o.columns, "<u2")
                c[np.arange(len(h)) + np.repeat(shift, n)] = _columns(h, o.columns)
                rows.append(c)
                size += len(c)
                if size >= most:
                    yield from cut(rows)
                    rows, size = [], 0
            if size:
                yield from cut(rows)

    def cut(rows):
        c = np.concatenate(rows)
        for lo in range(0, len(c), most):
            yield pa.RecordBatch.from_arrays([pa.array([c[lo : lo + most].tobytes()], pa.binary())], ["c"])

    return staged(documents.select("text").where(F.col("text").isNotNull()).mapInArrow(run, "c binary"), "passages")


def term_counts(passages: DataFrame, columns: int) -> np.ndarray:
    """Occurrences of each hashed term, over all words of all documents."""
    out = pa.schema([("c", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(columns + 1, np.int64)
        for b in batches:
            for c in b.column("c").to_pylist():
                total += np.bincount(np.frombuffer(c, "<u2"), minlength=columns + 1)
        at = np.flatnonzero(total[:columns])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], schema=out)

    counts = np.zeros(columns, np.int64)
    for c, k in passages.mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n")).collect():
        counts[c] = k
    return counts


def inverse_frequencies(counts: np.ndarray, o: DecontaminationOptions) -> np.ndarray:
    """Weights of the terms from the share of passages that hold them."""
    share = 1 - (1 - (counts + 0.5) / (counts.sum() + 1)) ** o.passage
    return np.maximum(-np.log(share) - o.common, 0.0).astype(np.float32)


def add_sketch(total: np.ndarray, cols: np.ndarray, idf: np.ndarray, rng, signs: int) -> None:
    """Adds TF-IDF passages of length one to ``signs`` random rows of ``total`` each, with random signs: the sum's
    Gram matrix is in expectation the passages'. ``cols`` holds a passage in each row, ``len(idf)`` where there is
    no word."""
    weight = np.append(idf, np.float32(0))
    step = 2048
    for lo in range(0, len(cols), step):
        c = cols[lo : lo + step]
        w = weight[c]
        w = w / np.sqrt(np.maximum((w * w).sum(axis=1, keepdims=True), 1e-12) * signs)
        rows = rng.integers(0, len(total), (len(c), signs))
        flip = rng.integers(0, 2, rows.shape) * 2.0 - 1.0
        flat = (rows[:, :, None] * total.shape[1] + c[:, None, :]).ravel()
        np.add.at(total.reshape(-1), flat, (flip[:, :, None] * w[:, None, :]).ravel())


def sketch(passages: DataFrame, counts: np.ndarray, o: DecontaminationOptions) -> tuple[np.ndarray, int]:
    """(sketch of the passages of all documents, their number), in one pass: a small matrix per part, summed row by
    row on the executors. Draws follow the contents of each row of ``passages``, so a repeated task draws the same."""
    spark = passages.sparkSession
    # partial sums in proportion to the words, however many files the table has
    parts = passages.coalesce(max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // o.part)))
    idf = inverse_frequencies(counts, o)
    columns, rows, signs, size = o.columns, o.sketch, o.signs, o.passage

    def run(batches):
        total, n = np.zeros((rows, columns + 1)), 0
        for b in batches:
            for c in b.column("c").to_pylist():
                cols = np.frombuffer(c, "<u2").astype(np.int64).reshape(-1, size)
                add_sketch(total, cols, idf, np.random.default_rng(zlib.crc32(c)), signs)
                n += len(cols)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array([x[:columns].astype(np.float32).tobytes() for x in total], pa.binary()), pa.array([n] * rows, pa.int64())], ["at", "m", "n"])

    def add(batches):  # rows come sorted: one sum at a time, however many parts there are
        at, m, n = None, None, 0
        for b in batches:
            for k, x, more in zip(*(b.column(c).to_pylist() for c in ("at", "m", "n")), strict=True):
                if k != at:
                    if at is not None:
                        yield out(at, m, n)
                    at, m, n = k, np.zeros(columns), 0
                m += np.frombuffer(x, np.float32)
                n += more
        if at is not None:
            yield out(at, m, n)

    def out(at, m, n):
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([m.astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], ["at", "m", "n"])

    schema, got, n = "at int, m binary, n long", np.zeros((rows, columns), np.float32), 0
    for at, m, n in parts.mapInArrow(run, schema).repartition("at").sortWithinPartitions("at").mapInArrow(add, schema).collect():
        got[at] = np.frombuffer(m, np.float32)
    return got, n


def latent_basis(items: list[Item], idf: np.ndarray, sketched: np.ndarray, n: int, o: DecontaminationOptions) -> np.ndarray:
    """Each term's weighted coordinates and, last, its squared weight: the leading right singular vectors of the
    items' rows over the sketch of all passages."""
    own = np.zeros((len(items), o.columns), np.float32)
    for row, i in zip(own, items, strict=True):
        c = _columns(np.array(i.words, np.uint64), o.columns)
        np.add.at(row, c, idf[c])
        row /= np.sqrt(max(float((idf[c] ** 2).sum()), 1e-12))
    a = np.vstack([own, np.sqrt(o.background * len(items) / max(n, 1)).astype(np.float32) * sketched]).astype(np.float64)
    s, u = np.linalg.eigh(a @ a.T)
    use = np.argsort(-s)[: o.rank]
    use = use[s[use] > 1e-10 * max(s.max(), 1e-300)]
    q = np.zeros((o.columns, o.rank), np.float32)
    q[:, : len(use)] = a.T @ (u[:, use] / np.sqrt(s[use]))
    return np.hstack([q * idf[:, None], (idf * idf)[:, None]])


class Searcher:
    """Finds the items of one lot in texts."""

    def __init__(self, items: list[Item], terms: np.ndarray, o: DecontaminationOptions):
        self.items, self.o = items, o
        self.terms = np.concatenate([terms, np.zeros((1, terms.shape[1]), np.float32)])
        own = [_columns(np.array(i.words, np.uint64), o.columns) for i in items]
        z = np.stack([terms[c, :-1].sum(axis=0) for c in own])
        self.z = np.ascontiguousarray((z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).T)
        self.direct: list[tuple[int, np.ndarray]] = []  # items that the cosine might miss, and which columns are theirs
        least, heaviest = np.minimum((terms[:, :-1] @ self.z).min(axis=0), 0.0), terms[:, -1].max()
        for k, c in enumerate(own):
            if self._least_cosine(c, self.z[:, k], least[k], heaviest) < 1.01 * o.cosine:
                member = np.zeros(len(self.terms), bool)
                member[c] = True
                self.direct.append((k, member))

    def _least_cosine(self, cols: np.ndarray, z: np.ndarray, least: float, heaviest: float) -> float:
        """The cosine that some window reaches wherever a verbatim copy begins and whatever words stand beside it."""
        inner = np.concatenate(([0.0], np.cumsum(self.terms[cols, :-1] @ z, dtype=np.float64)))
        squares = np.concatenate(([0.0], np.cumsum(self.terms[cols, -1], dtype=np.float64)))
        steps = [max(1, size // STEP // 2) * STEP for size in self.o.windows]
        begins = np.arange(max(steps))[:, None]
        best = np.full(len(begins), -1.0)
        for size, step in zip(self.o.windows, steps, strict=True):
            starts = np.arange(0, len(begins) + len(cols), step)
            lo, hi = np.clip(starts - begins, 0, len(cols)), np.clip(starts + size - begins, 0, len(cols))
            beside = size - (hi - lo)
            length = np.sqrt(np.maximum(squares[hi] - squares[lo] + beside * heaviest, 1e-9))
            best = np.maximum(best, ((inner[hi] - inner[lo] + beside * least) / length).max(axis=1))
        return float(best.min())

    def search(self, h: np.ndarray, begins: np.ndarray) -> list[list[tuple[int, float, bool]]]:
        """(item_id, share, answer) of the items found in each text, given the hashes of the texts' words."""
        o = self.o
        found: list[list[tuple[int, float, bool]]] = [[] for _ in begins[1:]]
        n = np.diff(begins)
        blocks = -(-n // STEP)
        begin = np.concatenate(([0], np.cumsum(blocks)))
        cols = np.full((begin[-1] + max(o.windows) // STEP) * STEP, len(self.terms) - 1, np.int64)
        cols[np.arange(len(h)) + np.repeat(begin[:-1] * STEP - begins[:-1], n)] = _columns(h, o.columns)
        sums = np.empty((len(cols) // STEP, self.terms.shape[1]), np.float32)
        for lo in range(0, len(sums), 128):
            part = cols[lo * STEP : (lo + 128) * STEP]
            self.terms.take(part, axis=0).reshape(-1, STEP, self.terms.shape[1]).sum(axis=1, out=sums[lo : lo + 128])
        best: dict[tuple[int, int], tuple[float, bool]] = {}
        for size in o.windows:
            m = size // STEP // 2  # blocks of half a window, by which windows move
            halves = sums[: len(sums) // m * m].reshape(-1, m, sums.shape[1]).sum(axis=1) if m > 1 else sums
            z = halves[:-1] + halves[1:]
            bound = o.cosine * np.sqrt(np.maximum(z[:, -1], 1e-9))
            # a projection is at least as long as its component along any item
            near = np.flatnonzero(np.einsum("ij,ij->i", z[:, :-1], z[:, :-1]) >= 0.999 * bound * bound)
            for lo in range(0, len(near), 4096):
                s = near[lo : lo + 4096]
                at, item = np.nonzero(z[s, :-1] @ self.z >= bound[s, None])
                for b, k in zip((s[at] * m).tolist(), item.tolist(), strict=True):
                    self._align(b, size, k, h, begins, begin, best)
        size = max(o.windows)
        starts = np.arange(0, begin[-1], max(1, size // STEP // 2))
        for k, member in self.direct:
            held = np.concatenate(([0], np.cumsum(member[cols].reshape(-1, STEP).sum(axis=1))))
            reach = -(-len(self.items[k].words) // STEP)
            around = held[np.minimum(starts + size // STEP + reach, len(held) - 1)] - held[np.maximum(starts - reach, 0)]
            for b in starts[around >= o.paraphrase * len(self.items[k].words)].tolist():
                self._align(b, size, k, h, begins, begin, best)
        for (d, k), got in best.items():
            found[d].append((self.items[k].item_id, *got))
        return found

    def _align(self, b: int, size: int, k: int, h, begins, begin, best) -> None:
        """Aligns an item with the words around the window at block ``b``, in each text the window touches."""
        d = int(np.searchsorted(begin, b, "right")) - 1
        while d < len(begin) - 1 and begin[d] < b + size // STEP:
            if best.get((d, k), (0.0,))[0] < 1.0:
                x = self.items[k]
                n = len(x.words)
                lo = (b - int(begin[d])) * STEP
                first = int(begins[d])
                got = verified(x, h[first + max(0, lo - n) : min(first + lo + size + n, int(begins[d + 1]))].tolist(), self.o)
                if got:
                    best[d, k] = max(got, best.get((d, k), got))
            d += 1


def _prepare(documents: DataFrame, benchmark: DataFrame, o: DecontaminationOptions) -> list[str]:
    """Paths of the lots: files of about ``items_per_pass`` items' texts with their projected terms."""
    import pandas as pd

    spark = documents.sparkSession
    tune(spark)
    items = staged(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct(), "items")
    n = items.count()
    if not n:
        return []
    passages = passages_of(documents, o)
    counts = term_counts(passages, o.columns)
    idf = inverse_frequencies(counts, o)
    fit = spark.sparkContext.broadcast((idf, *sketch(passages, counts, o)))  # a few arrays of ``columns`` numbers
    folder = shared_dir(spark, "lots")

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        import uuid

        rows = [(None if pd.isna(i) else int(i), t) for i, t in zip(part["item_id"].astype(object), part["text"], strict=True)]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        hashes = WordHashes()
        lot = [(i, t, x) for i, t in rows if (x := item_of(i, t, hashes))]
        if not lot:
            return pd.DataFrame({"lot": [key[0]], "path": [""]})
        terms = latent_basis([x for *_, x in lot], *fit.value, o)
        texts = [t.encode("utf-8", "surrogatepass") for _, t, _ in lot]
        fs, place = file_system(folder)
        fs.create_dir(place, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"  # of this attempt alone
        with fs.open_output_stream(f"{place}/{name}") as f:
            np.savez(f, terms=terms, ids=np.array([i if i is not None else 0 for i, *_ in lot]), known=np.array([i is not None for i, *_ in lot]), sizes=np.array([len(t) for t in texts]), texts=np.frombuffer(b"".join(texts), np.uint8))
        return pd.DataFrame({"lot": [key[0]], "path": [f"{folder}/{name}"]})

    dealt = items.withColumn("lot", F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-n // o.items_per_pass))))
    return [r.path for r in sorted(dealt.groupBy("lot").applyInPandas(build, "lot long, path string").collect()) if r.path]


def _searcher(path: str, hashes: WordHashes, o: DecontaminationOptions) -> Searcher:
    import io

    fs, place = file_system(path)
    with fs.open_input_file(place) as f:
        saved = np.load(io.BytesIO(f.read()))
        ends = np.cumsum(saved["sizes"])
        raw = saved["texts"].tobytes()
        items = [item_of(int(i) if k else None, raw[e - n : e].decode("utf-8", "surrogatepass"), hashes) for i, k, n, e in zip(saved["ids"], saved["known"], saved["sizes"], ends, strict=True)]
        return Searcher(items, saved["terms"], o)


class Search:
    """Searches runs of texts lot by lot, holding a few lots at a time."""

    def __init__(self, paths: list[str], o: DecontaminationOptions):
        self.paths, self.o, self.hashes, self.known = list(paths), o, WordHashes(), {}

    def _lot(self, path: str) -> Searcher:
        if path not in self.known:
            if len(self.known) >= self.o.held:
                self.known.pop(next(iter(self.known)))
            self.known[path] = _searcher(path, self.hashes, self.o)
        return self.known[path]

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, float, bool]]]:
        """(item_id, share, answer) of the items found in each text, each item once."""
        found: list[dict] = [{} for _ in texts]
        texts = [t or "" for t in texts]
        parts = [(lo, hi, *self.hashes(texts[lo:hi])) for lo, hi in lots(texts)]
        for path in self.paths:
            s = self._lot(path)
            for lo, hi, h, begins in parts:
                for to, hits in zip(found[lo:hi], s.search(h, begins), strict=True):
                    for item, *match in hits:
                        to[item] = max(to.get(item, match), match)
        self.paths.reverse()  # the lots held now are the first of the next run
        return [[(item, *match) for item, match in to.items()] for to in found]

    def runs(self, batches, column: str):
        """(batches, what was found in each of their texts) for runs of batches with about ``run`` characters."""
        held, texts, size = [], [], 0
        for b in batches:
            held.append(b)
            own = b.column(column).to_pylist()
            texts += own
            size += sum(len(t) for t in own if t)
            if size >= self.o.run:
                yield held, self(texts)
                held, texts, size = [], [], 0
        if held:
            yield held, self(texts)


def contaminated(documents: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()) -> DataFrame:
    """doc_id, item_id, share, answer: one row per document and benchmark item found in it."""
    paths = _prepare(documents, benchmark, options)
    schema = "doc_id long, item_id long, share double, answer boolean"
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64()), ("answer", pa.bool_())])

    def run(batches):
        for held, found in Search(paths, options).runs(batches, "text"):
            ids = [i for b in held for i in b.column("doc_id").to_pylist()]
            rows = [(ids[i], *x) for i, hits in enumerate(found) for x in hits]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    if not paths:
        return documents.sparkSession.createDataFrame([], schema)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_clean(documents: DataFrame, benchmark: DataFrame, options: DecontaminationOptions = DecontaminationOptions()) -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns."""
    paths = _prepare(documents, benchmark, options)
    if not paths:
        return documents

    def run(batches):
        for held, found in Search(paths, options).runs(batches, "text"):
            at = 0
            for b in held:
                yield b.filter(pa.array([not hits for hits in found[at : at + b.num_rows]], pa.bool_()))
                at += b.num_rows

    return documents.mapInArrow(run, documents.schema)
