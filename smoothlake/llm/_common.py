"""What the training-data operators share: the cluster's shared folder, written tables, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold; texts can be long, so that batches stay within a Python worker's memory.
ARROW_ROWS = 512


def tune(spark: SparkSession) -> None:
    """Session settings that the operators' Python passes need; results do not depend on them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and the session runs on one machine (tests) a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="smoothlake-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back: the lineage ends there,
    and the loss of an executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(file system, path) of a URI, for tasks that write or read whole files of the shared folder."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def scan_partitions(df: DataFrame) -> int:
    """Partitions the input's scan has: grows with the bytes of the input."""
    return max(1, df.rdd.getNumPartitions())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) on unsigned integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


WORD, LETTERS = re.compile(r"[^\W_]+"), re.compile(r"[^\W\d_]+")


def _listed(pattern: re.Pattern) -> re.Pattern:
    """The same one-character class, written out for the characters of Latin-1, which is matched faster."""
    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(256) if pattern.fullmatch(chr(c))) + "]+")


_LATIN = {p: _listed(p) for p in (WORD, LETTERS)}


def word_list(text: str, pattern: re.Pattern = WORD) -> list[str]:
    """The lower-cased words of a text: runs of letters and digits, or of letters alone."""
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return pattern.findall(text)
    return _LATIN[pattern].findall(text)


#: Characters of which one pass hashes the words at most; longer words are hashed one by one.
RUN = 1 << 18
_POWERS = np.empty(RUN + 1, np.uint64)
_POWERS[0] = 1
_POWERS[1:] = 0x9E3779B97F4A7C15
np.multiply.accumulate(_POWERS, out=_POWERS)
_LOWER = [ord(chr(c).lower()) for c in range(256)]  # of Latin-1, which it does not leave
_VALUES = mix(np.array(_LOWER, np.uint64) + np.uint64(1))
_IS_WORD = np.array([bool(WORD.fullmatch(chr(c))) for c in _LOWER])


class WordHashes:
    """64-bit hashes of the lower-cased words of texts, whole batches at a time and without a string per word.

    A word's hash is a polynomial in its characters' values, taken from running sums over the characters of
    many texts at once. It depends on the word alone. Memory: some 40 bytes per character of ``RUN``, beside
    the texts' characters and their words' hashes.
    """

    def __init__(self):
        self.kind = np.full(0x110000, -1, np.int8)  # of characters beyond Latin-1: whether words hold them, as far as known

    def _mask(self, codes: np.ndarray) -> np.ndarray:
        if codes.dtype == np.uint8:
            return _IS_WORD.take(codes)
        kind = self.kind.take(codes)
        if (kind < 0).any():
            for c in np.unique(codes[kind < 0]).tolist():
                self.kind[c] = bool(WORD.fullmatch(chr(c)))
            kind = self.kind.take(codes)
        return kind > 0

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words of all texts one after another, where each text's begin and the last one's end)."""
        try:  # case is part of the tables
            codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            texts = [t.lower() for t in texts]
            codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        mask = self._mask(codes)
        edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            begin = int(starts[at])
            to = int(np.searchsorted(ends, begin + RUN, "right"))
            if to == at:  # a word longer than a run
                word = codes[begin : ends[at]]
                out[at] = xxhash.xxh64_intdigest((np.array(_LOWER, "<u4").take(word) if word.dtype == np.uint8 else word).tobytes())
                at += 1
                continue
            part = codes[begin : ends[to - 1]]
            values = _VALUES.take(part) if part.dtype == np.uint8 else mix(part.astype(np.uint64) + np.uint64(1))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values * _POWERS[: len(part)], out=sums[1:])
            s, e = starts[at:to] - begin, ends[at:to] - begin
            out[at:to] = mix((sums[e] - sums[s]) * _POWERS[RUN - s])
            at = to
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        return out, np.searchsorted(starts, first)

    def of(self, text: str) -> np.ndarray:
        return self([text])[0]


def lots(texts: list[str], most: int = 1 << 15):
    """(from, to) of runs of texts with about ``most`` characters each, few enough for the arrays to stay in cache."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def null_safe(c: str):
    return F.coalesce(F.col(c), F.lit(""))
