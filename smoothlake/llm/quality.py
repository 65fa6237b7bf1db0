"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

A text's n-grams are words and pairs of words (lower-cased), and runs of one to four symbols of its shape:
the text with every run of lower-case letters, capitals or digits drawn together to one symbol and all else
kept, so ``STAN!! of.`` is ``A!! a.``. Each n-gram is hashed to one of ``2**bits`` buckets; a text is the set of its
buckets. With counts of texts per bucket and class (and ``smoothing`` added), r is the log ratio of the
classes' normalised counts; a text's vector holds r at its buckets, scaled to length one, beside a constant.

The weights minimise ``|w|^2 / 2 + cost * sum of hinge losses`` by dual coordinate descent. Labelled texts are dealt into
blocks by a hash of the text; in a round every block improves its own dual variables with the weights it got
and the change that its own steps make, counted once per block so that the blocks' changes may simply be
added. Rounds end when the duality gap is below ``gap`` of the objective, so the result is the optimum, not what
some number of rounds leaves. The tasks hold the texts; the driver holds weights and dual variables only, and hands
them on by a file of the shared folder that lasts for the round.

The same rounds fit the model once more without each of ``folds`` parts of the texts, with log ratios that leave the part
out, too; the margins of the texts left out fix the logistic curve that turns margins into scores.

Learned from: a bounded sample, ``ids_per_class`` labelled ids of each class (those with the smallest hashes)
that are not held out, of which equal texts count once; a bound on texts holds in expectation where one id
has many texts. Every count and score covers whole texts.

Edge cases: a null text is scored as an empty one, which has the shape of an empty line, and teaches nothing.
Very long texts are read whole. An id labelled both 0 and 1, or otherwise, teaches nothing; equal labels of an id
count once; equal texts with different labels count once each. Rows with equal or null ids are scored like any
other. With labels of one class alone the score is the smoothed share of label 1, and one half without any label. An
empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, file_system, mix, shared_dir, staged, tune


@dataclass(frozen=True)
class QualityOptions:
    """ids_per_class, block_texts: bounds of the sample and of a block. bits: buckets are 2 to this power.
    shape: longest n-gram of the shape. rounds, epochs: at most, and passes over a block in one."""

    ids_per_class: int = 5000
    block_texts: int = 16_384
    bits: int = 17
    shape: int = 4
    smoothing: float = 1.0
    cost: float = 1.0
    gap: float = 0.02
    rounds: int = 40
    epochs: int = 8
    folds: int = 3


_RUNS = np.array([ord("a"), ord("A"), ord("0")])


def _symbol(c: str) -> int:
    if c.isupper():
        return ord("A")
    if c.isalpha():
        return ord("a")
    if c.isdigit():
        return ord("0")
    return ord(" ") if c.isspace() and c != "\n" else ord(c)


_SYMBOLS = np.array([_symbol(chr(c)) for c in range(256)], np.uint32)


class Features:
    """The distinct buckets of texts."""

    def __init__(self, options: QualityOptions):
        self.words, self.options = WordHashes(), options
        self.mask = np.uint64((1 << options.bits) - 1)
        self.last = np.zeros(1 << options.bits, np.int64)

    def _shape(self, text: str) -> np.ndarray:
        try:
            s = _SYMBOLS.take(np.frombuffer(f"\n{text}\n".encode("latin-1"), np.uint8))
        except UnicodeEncodeError:
            s = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
            wide = s > 255
            kinds, at = np.unique(s[wide], return_inverse=True)
            s = _SYMBOLS.take(np.minimum(s, 255))
            s[wide] = np.array([_symbol(chr(c)) for c in kinds], np.uint32)[at]
        same = s[1:] == s[:-1]
        same &= np.isin(s[1:], _RUNS)
        return s[np.concatenate(([True], ~same))]

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        words = self.words.of(text)
        found = [words, mix(words[:-1] * np.uint64(3) + words[1:])]
        s = self._shape(text).astype(np.uint64) + np.uint64(1)
        h = s
        for n in range(1, self.options.shape + 1):
            if n > 1:
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + s[n - 1 :]
            found.append(mix(h + np.uint64(n << 56)))
        ids = (np.concatenate(found) & self.mask).astype(np.int64)
        at = np.arange(len(ids))
        self.last[ids] = at
        return ids[self.last[ids] == at].astype(np.uint32)


def held_out(c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions()) -> DataFrame:
    """(y, h, ids): class, text hash and buckets of the distinct texts to learn from, written once."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("top"))
        .where("y = top AND y IN (0, 1)")
    )
    # bounded by ids_per_class, hence fit to be broadcast
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(options.ids_per_class) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1]).select("doc_id", F.col("y").cast("int").alias("y"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    distinct = texts.groupBy("y", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    out = pa.schema([("y", pa.int32()), ("h", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        features = Features(options)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), b.column(1), pa.array([features(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], schema=out)

    return staged(distinct.mapInArrow(run, "y int, h long, ids binary"), "quality")


@dataclass
class Problem:
    """One fit: which fold it leaves out (-1: none), the log ratios, the weights and the constant's weight."""

    without: int
    ratios: np.ndarray
    weights: np.ndarray


@dataclass
class QualityModel:
    """Bucket weights (with log ratios in), squared log ratios, constant, and the logistic curve of margins."""

    weights: np.ndarray
    squares: np.ndarray
    constant: float
    slope: float
    shift: float

    def score(self, ids: np.ndarray) -> float:
        norm = float(np.sqrt(self.squares[ids].sum())) or 1.0
        m = float(self.weights[ids].sum()) / norm + self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -500, 500))))


def _fold(h, folds: int):
    return (np.asarray(h, np.int64).view(np.uint64) >> np.uint64(40)) % np.uint64(folds)


def log_ratios(texts: DataFrame, options: QualityOptions) -> tuple[list[np.ndarray], np.ndarray]:
    """Log ratios without each fold and over all, and the number of texts by fold and class."""
    size, folds = 1 << options.bits, options.folds
    out = pa.schema([("at", pa.int32()), ("n", pa.list_(pa.int64()))])

    def count(batches):
        table = np.zeros((size + 1, folds * 2), np.int64)
        for b in batches:
            cells = _fold(b.column(1).to_numpy(), folds).astype(np.int64) * 2 + b.column(0).to_numpy()
            for cell, ids in zip(cells.tolist(), b.column(2).to_pylist(), strict=True):
                table[np.frombuffer(ids, np.uint32), cell] += 1
                table[size, cell] += 1
        some = np.flatnonzero(table.any(axis=1))
        for lo in range(0, len(some), 1 << 14):
            part = some[lo : lo + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(table[part].ravel()), folds * 2).cast(pa.list_(pa.int64()))], schema=out)

    sums = texts.mapInArrow(count, "at int, n array<long>").groupBy("at").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(folds * 2)]).toPandas().to_numpy()
    table = np.zeros((size + 1, folds * 2))
    if len(sums):
        table[sums[:, 0].astype(int)] = sums[:, 1:]
    found = []
    for fold in (*range(folds), -1):
        use = [k for k in range(folds) if k != fold]
        q, p = (options.smoothing + table[:size, [2 * k + y for k in use]].sum(axis=1) for y in (0, 1))
        found.append(np.log((p / p.sum()) / (q / q.sum())))
    return found, table[size].reshape(folds, 2)


def _blocks(texts: DataFrame, n: int, options: QualityOptions) -> DataFrame:
    """One row per block of texts: (block, h, y, starts, ids), all but the first as bytes."""
    import pandas as pd

    count = max(1, -(-n // options.block_texts))

    def gather(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "y"])
        lengths = [len(b) // 4 for b in part["ids"]]
        return pd.DataFrame(
            {"block": [key[0]], "h": [part["h"].to_numpy(np.int64).tobytes()], "y": [part["y"].to_numpy(np.int64).tobytes()], "starts": [np.cumsum([0, *lengths]).tobytes()], "ids": [b"".join(part["ids"])]}
        )

    dealt = texts.withColumn("block", F.pmod(F.col("h"), F.lit(count)).cast("int"))
    return staged(dealt.groupBy("block").applyInPandas(gather, "block int, h binary, y binary, starts binary, ids binary"), "blocks")


def _improve(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, alpha: np.ndarray, w: np.ndarray, blocks: int, options: QualityOptions, order: np.random.Generator):
    """Dual coordinate descent over one block: (dual variables, change of the weights)."""
    u, alpha = w.copy(), alpha.copy()
    for _ in range(options.epochs):
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            slack = 1 - y[i] * (float(u[r] @ v) + u[-1])
            new = min(max(alpha[i] + slack / (blocks * 2.0), 0.0), options.cost)  # vectors have length one, and a constant
            if new != alpha[i]:
                step = blocks * (new - alpha[i]) * y[i]
                u[r] += step * v
                u[-1] += step
                alpha[i] = new
    return alpha, (u - w) / blocks


def descend(blocks: DataFrame, ratios: list[np.ndarray], options: QualityOptions) -> tuple[list[Problem], list[float]]:
    """All problems fitted together, and the relative duality gap each ended with."""
    size, folds = 1 << options.bits, options.folds
    sc = blocks.sparkSession.sparkContext
    problems = [Problem(f, r, np.zeros(size + 1)) for f, r in zip((*range(folds), -1), ratios, strict=True)]
    count = blocks.count()
    shared = sc.broadcast([r.astype(np.float32) for r in ratios])
    folder = shared_dir(blocks.sparkSession, "rounds")
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    duals: dict[tuple[int, int], np.ndarray] = {}
    gaps = [1.0] * len(problems)
    out = pa.schema([("block", pa.int32()), ("problem", pa.int32()), ("alpha", pa.binary()), ("at", pa.binary()), ("change", pa.binary()), ("loss", pa.float64()), ("dual", pa.float64())])
    for turn in range(options.rounds):
        with fs.open_output_stream(f"{path}/{turn}") as sink:
            sink.write(pickle.dumps(([p.weights for p in problems], duals)))
        open_ = [g > options.gap for g in gaps]

        def run(batches, turn=turn, open_=open_):
            fs, path = file_system(folder)
            with fs.open_input_file(f"{path}/{turn}") as source:
                weights, duals = pickle.loads(source.read())
            for b in batches:
                for block, h, y, starts, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    h, y, starts, ids = np.frombuffer(h, np.int64), np.frombuffer(y, np.int64) * 2.0 - 1, np.frombuffer(starts, np.int64), np.frombuffer(ids, np.uint32)
                    for k, r in enumerate(shared.value):
                        if not open_[k]:
                            continue
                        use = np.flatnonzero(_fold(h, folds) != (k if k < folds else folds))
                        rows = [ids[starts[i] : starts[i + 1]].astype(np.int64) for i in use]
                        values = [_unit(r[x]) for x in rows]
                        own = duals.get((block, k), np.zeros(len(use)))
                        w = weights[k]
                        margins = np.array([float(w[x] @ v) + w[-1] for x, v in zip(rows, values, strict=True)])
                        loss = options.cost * float(np.maximum(0, 1 - y[use] * margins).sum())
                        alpha, change = _improve(rows, values, y[use], own, w, count, options, np.random.default_rng([turn, block, k]))
                        at = np.flatnonzero(change)
                        yield pa.RecordBatch.from_pydict(
                            {"block": [block], "problem": [k], "alpha": [alpha.tobytes()], "at": [at.astype(np.int32).tobytes()], "change": [change[at].tobytes()], "loss": [loss], "dual": [float(own.sum())]}, schema=out
                        )

        rows = blocks.mapInArrow(run, "block int, problem int, alpha binary, at binary, change binary, loss double, dual double").collect()
        fs.delete_file(f"{path}/{turn}")
        for k, p in enumerate(problems):
            own = sorted((r for r in rows if r["problem"] == k), key=lambda r: r["block"])
            if not own:
                continue
            half = 0.5 * float(p.weights @ p.weights)
            primal = half + sum(r["loss"] for r in own)
            gaps[k] = (primal - (sum(r["dual"] for r in own) - half)) / max(primal, 1e-300) if turn else 1.0
            if gaps[k] <= options.gap:
                continue  # these weights and dual variables stand
            for r in own:
                duals[r["block"], k] = np.frombuffer(r["alpha"])
                p.weights[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["change"])
        if max(gaps) <= options.gap:
            break
    return problems, gaps


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(float)
    return v / (float(np.sqrt(v @ v)) or 1.0)


def _left_out(blocks: DataFrame, problems: list[Problem], options: QualityOptions) -> np.ndarray:
    """(margin, class) of every text under the problem that left it out: two numbers for a text of the sample."""
    shared = blocks.sparkSession.sparkContext.broadcast([(p.ratios, p.weights) for p in problems[:-1]])

    def run(batches):
        for b in batches:
            for h, y, starts, ids in zip(*(b.column(c).to_pylist() for c in ("h", "y", "starts", "ids")), strict=True):
                fold, starts, ids = _fold(np.frombuffer(h, np.int64), options.folds), np.frombuffer(starts, np.int64), np.frombuffer(ids, np.uint32)
                m = []
                for i, k in enumerate(fold.tolist()):
                    r, w = shared.value[k]
                    x = ids[starts[i] : starts[i + 1]]
                    m.append(float(w[x] @ _unit(r[x])) + w[-1])
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.float64()), pa.array(np.frombuffer(y, np.int64))], ["margin", "y"])

    return blocks.mapInArrow(run, "margin double, y long").toPandas().sort_values(["margin", "y"]).to_numpy(float)


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve through margins and classes, by Newton's method on smoothed targets."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x = np.column_stack([margins, np.ones(len(y))])
    b = np.array([0.0, np.log((ones + 1) / (len(y) - ones + 1))])

    def loss(b):
        eta = x @ b
        return float((np.logaddexp(0, eta) - target * eta).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        gradient = x.T @ (p - target)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), gradient)
        size, before = 1.0, loss(b)
        while size > 1e-8 and loss(b - size * step) > before:
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return float(b[0]), float(b[1])


def fit(documents: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions()) -> QualityModel:
    """A model of the labelled documents that are not held out."""
    texts = sample(documents, labels, options)
    counted = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    shares = {y: min(1.0, 2 * options.ids_per_class / n) for y, n in counted.items()}  # below one only where ids have many texts
    for y, share in shares.items():
        texts = texts.where((F.col("y") != y) | (F.pmod(F.col("h"), F.lit(1_000_003)) < share * 1_000_003))
    size = 1 << options.bits
    if len(counted) < 2:
        ones, n = counted.get(1, 0), sum(counted.values())
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log((ones + 1) / (n - ones + 1))))
    ratios, by_fold = log_ratios(texts, options)
    blocks = _blocks(texts, int(by_fold.sum()), options)
    problems, gaps = descend(blocks, ratios, options)
    if max(gaps) > 0.1:
        raise RuntimeError(f"hinge-loss fits did not settle in {options.rounds} rounds: {gaps}")
    margins = _left_out(blocks, problems, options)
    slope, shift = logistic_curve(margins[:, 0], margins[:, 1])
    final = problems[-1]
    return QualityModel(final.weights[:-1] * final.ratios, final.ratios**2, float(final.weights[-1]), slope, shift)


def judge(documents: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions(), model: QualityModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    tune(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents, labels, options))
    names = ["doc_id", "held_out", "score", "predicted"]

    def run(batches):
        features, m = Features(options), shared.value
        for b in batches:
            score = np.array([m.score(features(t)) for t in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
