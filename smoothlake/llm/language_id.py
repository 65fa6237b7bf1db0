"""Language identification with interpolated Kneser-Ney character models.

A word is read as ``^^^word$``: contexts start anew at each word, so a word's log-probability under every
language is a function of the word alone, and is kept in a bounded cache while a partition is scanned.
The models of all languages share one sorted array of n-gram hashes per order, with one column per
language for the discounted probability and for the interpolation weight.

Edge cases: a null text, or a text without a letter, gives ``und`` with score 0 and is rejected.
Rows with null ids are judged like any other, repeated rows each by itself; equal cross-entropies go to the language
first in the alphabet; very long texts are read whole. An empty table gives an empty table; without any labelled row
every text gives ``und``. Extra columns are ignored, or pass through untouched where documents are returned.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LETTERS, mix, tune, word_list

PAD, END = 1, 2  # code points which no letter has


@dataclass(frozen=True)
class LanguageIdOptions:
    """order: length of the longest n-gram. documents_per_language: bound (in expectation) of the sample
    the models are fitted on, drawn by hashes of the ids; a tenth of it calibrates rejection.
    quantile, slack, least_excess: a text is rejected if its cross-entropy exceeds the mean of its language
    by more than ``slack`` times that quantile of the calibration texts' excess, and by ``least_excess`` nats;
    the excess of texts under ``steady`` symbols is damped by the square root of their length. few, folds: a
    language with fewer calibration texts is calibrated by cross-validation over all texts of its sample."""

    order: int = 4
    documents_per_language: int = 3000
    quantile: float = 0.999
    slack: float = 1.6
    least_excess: float = 1.2
    steady: int = 400
    few: int = 20
    folds: int = 10
    cache_words: int = 300_000


@dataclass
class LanguageModel:
    languages: list[str]
    order: int
    alphabet: int
    grams: list[np.ndarray] = field(default_factory=list)  # per order: sorted hashes
    alpha: list[np.ndarray] = field(default_factory=list)  # per order: [grams, languages]
    contexts: list[np.ndarray] = field(default_factory=list)
    gamma: list[np.ndarray] = field(default_factory=list)
    mean: np.ndarray | None = None  # per language, of the cross-entropy of calibration texts
    limit: np.ndarray | None = None  # per language, of the damped excess over the mean
    steady: int = 400


def _codes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with their padding in one array, and a mask of the positions that predict."""
    joined = "".join(chr(PAD) * (order - 1) + w + chr(END) for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, codes != PAD


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position (the first n-1 positions are of no use)."""
    h = np.zeros(len(codes), np.uint64)
    for back in range(n):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[back:] = codes[: len(codes) - back]
        h = h * np.uint64(0x9E3779B97F4A7C15) + (shifted + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h + np.uint64(n))


def ngram_counts(texts, order: int) -> Counter:
    """Counts of the highest-order n-grams (strings with padding) of lower-cased words."""
    words: Counter = Counter()
    for text in texts:
        words.update(word_list(text, LETTERS))
    grams: Counter = Counter()
    for w, c in words.items():
        s = chr(PAD) * (order - 1) + w + chr(END)
        for i in range(len(s) - order + 1):
            grams[s[i : i + order]] += c
    return grams


def _gram_hash(grams: list[str], n: int) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return _hashes(codes, n)[n - 1 :: n]


def kneser_ney(counts: dict[str, Counter], order: int) -> LanguageModel:
    """Interpolated Kneser-Ney from the counts of the highest order: lower orders count distinct left
    neighbours. One discount per order and language, n1 / (n1 + 2 n2)."""
    languages = sorted(counts)
    letters = {g[-1] for c in counts.values() for g in c}
    model = LanguageModel(languages, order, len(letters) + 1)
    per = {lang: {order: counts[lang]} for lang in languages}
    for lang in languages:
        for n in range(order - 1, 0, -1):
            lower: Counter = Counter()
            for g in per[lang][n + 1]:
                lower[g[1:]] += 1
            per[lang][n] = lower
    for n in range(1, order + 1):
        grams = sorted({g for lang in languages for g in per[lang][n]})
        contexts = sorted({g[:-1] for g in grams})
        at, ctx_at = {g: i for i, g in enumerate(grams)}, {g: i for i, g in enumerate(contexts)}
        alpha = np.zeros((len(grams), len(languages)))
        gamma = np.ones((len(contexts), len(languages)))
        for j, lang in enumerate(languages):
            c = per[lang][n]
            seen = Counter(c.values())
            discount = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] and seen[2] else 0.5
            total: Counter = Counter()
            distinct: Counter = Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                distinct[g[:-1]] += 1
            for g, v in c.items():
                alpha[at[g], j] = max(v - discount, 0.0) / total[g[:-1]]
            for h, v in total.items():
                gamma[ctx_at[h], j] = discount * distinct[h] / v
        h = _gram_hash(grams, n) if grams else np.empty(0, np.uint64)
        k = np.argsort(h)
        model.grams.append(h[k])
        model.alpha.append(alpha[k].astype(np.float32))
        if n > 1:
            h = _gram_hash(contexts, n - 1)
            k = np.argsort(h)
            model.contexts.append(h[k])
            model.gamma.append(gamma[k].astype(np.float32))
        else:
            model.contexts.append(np.zeros(1, np.uint64))
            model.gamma.append(gamma[:1].astype(np.float32) if len(gamma) else np.ones((1, len(languages)), np.float32))
    return model


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    out = np.full((len(wanted), values.shape[1]), missing, np.float32)
    if len(keys):
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[i] == wanted
        out[hit] = values[i[hit]]
    return out


def word_scores(model: LanguageModel, words: list[str]) -> np.ndarray:
    """[words, languages]: the natural log-probability of each word with its end mark."""
    codes, predicts = _codes(words, model.order)
    use = np.flatnonzero(predicts)
    p = np.full((len(use), len(model.languages)), 1.0 / model.alphabet, np.float32)
    for n in range(1, model.order + 1):
        alpha = _rows(model.grams[n - 1], model.alpha[n - 1], _hashes(codes, n)[use], 0.0)
        if n == 1:
            gamma = model.gamma[0]
        else:
            gamma = _rows(model.contexts[n - 1], model.gamma[n - 1], _hashes(codes, n - 1)[use - 1], 1.0)
        p = alpha + gamma * p
    logs = np.log(np.maximum(p, 1e-30))
    ends = np.cumsum([len(w) + 1 for w in words])
    return np.add.reduceat(logs, np.concatenate(([0], ends[:-1])), axis=0)


class Judge:
    """Scores texts with one model; keeps the scores of frequent words."""

    def __init__(self, model: LanguageModel, cache_words: int = 300_000):
        self.model, self.most = model, cache_words
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, max(1, len(self.model.languages))), np.float32)

    def learn(self, words) -> None:
        new = [w for w in set(words) if w not in self.known]
        if not new:
            return
        at = len(self.known)
        if at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(new), len(self.table)), self.table.shape[1]), np.float32)])
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.table[at + lo : at + lo + len(part)] = word_scores(self.model, part)
        for i, w in enumerate(new):
            self.known[w] = at + i

    def entropies(self, text: str | None) -> tuple[np.ndarray | None, int]:
        """Cross-entropy per symbol under each language, and the number of symbols; None without a letter."""
        words = word_list(text, LETTERS) if text and self.model.languages else []
        if not words:
            return None, 0
        if len(self.known) > self.most:
            self.forget()
        self.learn(words)
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n = sum(map(len, words)) + len(words)
        return -self.table[rows].sum(axis=0, dtype=np.float64) / n, n

    def judge(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """(language, score, cross-entropy, rejected)."""
        h, n = self.entropies(text)
        if h is None:
            return "und", 0.0, None, True
        best = int(np.argmin(h))
        score = float(1.0 / np.exp(np.minimum((h[best] - h) * n, 0.0)).sum())
        m = self.model
        rejected = m.limit is not None and (h[best] - m.mean[best]) * min(1.0, (n / m.steady) ** 0.5) > m.limit[best]
        return m.languages[best], score, float(h[best]), bool(rejected)


def held_out(c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, options: LanguageIdOptions = LanguageIdOptions()) -> LanguageModel:
    """Fits the models on a bounded sample of the labelled documents that are not held out.

    Counting runs on the executors; the driver gets one row per distinct n-gram of the sample.
    """
    order = options.order
    labelled = (
        documents.select("doc_id", "text", "lang")
        .where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)))
    )
    # each language's share of draws that gives the expected number of documents: no sort, no shuffle of texts
    sizes = labelled.groupBy("lang").count().collect()
    shares = F.create_map(*[F.lit(v) for r in sizes for v in (r.lang, options.documents_per_language / r["count"] * 1e6)]) if sizes else None
    sample = labelled.where(F.col("draw") < shares[F.col("lang")]) if sizes else labelled

    def count(batches):
        texts: dict[tuple[str, bool], list[str]] = {}
        grams: dict[str, Counter] = {}
        kept = []
        for b in batches:
            for lang, text, draw in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), b.column("draw").to_pylist(), strict=True):
                if draw % 10:
                    texts.setdefault(lang, []).append(text)
                else:
                    kept.append((lang, text))
            for lang, several in texts.items():
                grams.setdefault(lang, Counter()).update(ngram_counts(several, order))
            texts.clear()
        for lang, c in grams.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "gram": list(c), "n": list(c.values())}, schema=out)
        for lang, text in kept:
            yield pa.RecordBatch.from_pydict({"lang": [lang], "gram": [text], "n": [0]}, schema=out)

    out = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
    counted = sample.mapInArrow(count, "lang string, gram string, n long")
    counts: dict[str, Counter] = {}
    held: list[tuple[str, str]] = []
    for lang, gram, n, zero in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), (F.max("n") == 0).alias("zero")).collect():
        if zero:
            held.append((lang, gram))
        else:
            counts.setdefault(lang, Counter())[gram] = n
    model = kneser_ney(counts, order)
    values = _held_entropies(model, held, options)
    few = [lang for j, lang in enumerate(model.languages) if len(values.get(j, ())) < options.few]
    if few:
        texts: dict[str, list[str]] = {}
        for lang, text in sample.where(F.col("lang").isin(few)).select("lang", "text").collect():
            texts.setdefault(lang, []).append(text)
        for lang, several in texts.items():
            values[model.languages.index(lang)] = _crossed_entropies(several, model.alphabet, options)
    _calibrate(model, values, options)
    return model


def _held_entropies(model: LanguageModel, held: list[tuple[str, str]], options: LanguageIdOptions) -> dict[int, list[tuple[float, int]]]:
    """Per best language, the cross-entropy and length of the calibration texts."""
    judge = Judge(model, options.cache_words)
    values: dict[int, list[tuple[float, int]]] = {}
    for _, text in sorted(held):
        h, n = judge.entropies(text)
        if h is not None:
            values.setdefault(int(np.argmin(h)), []).append((float(h.min()), n))
    return values


def _crossed_entropies(texts: list[str], alphabet: int, options: LanguageIdOptions) -> list[tuple[float, int]]:
    """Cross-entropy and length of each text of one language under the model of the other folds' texts. Equal
    texts share a fold; a single text is read as two, its words in turn."""
    distinct = sorted({t for t in texts if word_list(t, LETTERS)})
    if len(distinct) == 1:
        w = word_list(distinct[0], LETTERS)
        distinct = [" ".join(part) for part in (w[::2], w[1::2]) if part]
    folds = [distinct[i :: options.folds] for i in range(min(options.folds, len(distinct)))]
    counts = [ngram_counts(f, options.order) for f in folds]
    pairs = []
    for i, fold in enumerate(folds):
        others: Counter = Counter()
        for j, c in enumerate(counts):
            if j != i:
                others.update(c)
        if others:
            model = kneser_ney({"": others}, options.order)
            model.alphabet = alphabet
            judge = Judge(model, options.cache_words)
            pairs += [(float(h[0]), n) for h, n in map(judge.entropies, fold)]
    return pairs


def _calibrate(model: LanguageModel, values: dict[int, list[tuple[float, int]]], options: LanguageIdOptions) -> None:
    """Mean and limit of each language. Where fewer than ``few`` texts give the excess, that of all languages
    does; a language whose texts hold a single word has nothing to compare and rejects nothing."""
    k = len(model.languages)
    model.steady = options.steady
    model.mean, model.limit = np.zeros(k), np.full(k, np.inf)
    excess = {}
    for j, pairs in values.items():
        if pairs:
            h, n = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
            model.mean[j] = np.average(h, weights=n)
            excess[j] = (h - model.mean[j]) * np.minimum(1.0, np.sqrt(n / options.steady))
    for j, own in excess.items():
        e = own if len(own) >= options.few else np.concatenate(list(excess.values()))
        model.limit[j] = max(options.slack * np.quantile(e, options.quantile), options.least_excess)


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
)


def identify(documents: DataFrame, options: LanguageIdOptions = LanguageIdOptions(), model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected: one row per document."""
    tune(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(model or fit(documents, options))
    cache = options.cache_words

    def run(batches):
        judge = Judge(shipped.value, cache)
        for b in batches:
            found = [judge.judge(t) for t in b.column("text").to_pylist()]
            lang, score, h, rejected = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(h, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_identified(documents: DataFrame, options: LanguageIdOptions = LanguageIdOptions(), model: LanguageModel | None = None) -> DataFrame:
    """The documents whose language is not rejected, with all their columns."""
    tune(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(model or fit(documents, options))
    cache = options.cache_words

    def run(batches):
        judge = Judge(shipped.value, cache)
        for b in batches:
            yield b.filter(pa.array([not judge.judge(t)[3] for t in b.column("text").to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
