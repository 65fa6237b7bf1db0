"""Spelling variants: words one edit apart, found by Levenshtein automata run over shards of a compact trie.

Words come from whole texts: runs of Latin letters, of which one in ``every`` (by a checksum of document and
run) loses a code point. Tasks count them, Spark adds the counts up, and what is left after the frequency
cut is sorted by range and cut into shards of bounded size. Each task turns its shards into compact (path
compressed) tries and writes them to the shared folder; that is how a shard is broadcast: every task that
needs it reads it there, so nothing passes through the driver, and a task holds a bounded number of shards
and of words whatever the vocabulary's size.

Searching: a task takes a bounded run of words and goes through the shards. The words' distance-one Levenshtein
automata (their states: positions reached without an edit and with one) walk a shard's trie depth-first, a block
of states at a time in arrays, entering only branches on which they are alive. Words at which it accepts with exactly one edit are the near words: the task counts them
and keeps the most frequent, so a word gives one row however many near words it has.

Roots: a form is at least ``ratio`` times as frequent as its word, so chains of forms cannot turn back and are
short; they are followed by pointer jumping over written tables.

Edge cases: a null text has no words; a null doc_id reads as the empty text in the checksum. Very long texts
are read whole, very long words are kept whole. Of near words with equal counts the smallest in code-point
order is the form. Repeated rows count as often as they occur. An empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import file_system, shared_dir, staged, tune


@dataclass(frozen=True)
class SpellingOptions:
    """least: code points of a word. least_count: occurrences. ratio: how many times as frequent a form is.
    every: one run in so many is misspelt. shard_words, shard_chars: bounds of a trie shard. run_words,
    run_chars: bounds of the words a task searches for at a time. held_shards: tries a worker keeps."""

    least: int = 7
    least_count: int = 2
    ratio: int = 10
    every: int = 31
    shard_words: int = 1 << 15
    shard_chars: int = 1 << 22
    run_words: int = 1 << 15
    run_chars: int = 1 << 21
    held_shards: int = 4


#: Latin-1 bytes of a text to those of its runs: A-Z lower-cased, letters kept, the rest spaces. A character
#: beyond Latin-1 is written as a question mark, which is no letter.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def spellings(doc_id: int | None, text: str, options: SpellingOptions) -> Counter:
    """Counts of the spellings (Latin-1 bytes) of one text."""
    runs = Counter(r for r in text.encode("latin-1", "replace").translate(_FOLD).split() if len(r) >= options.least)
    before = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    found: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
        if h % options.every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < options.least:
                continue
        found[run] += n
    return found


def word_counts(documents: DataFrame, options: SpellingOptions = SpellingOptions()) -> DataFrame:
    """(word, n): all spellings of at least ``least`` code points with at least ``least_count`` occurrences."""
    tune(documents.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        counts: Counter = Counter()
        held = 0  # bytes of the keys, some of which may have been there before

        def out():
            for lo in range(0, len(keys := list(counts)), 1 << 14):
                part = keys[lo : lo + (1 << 14)]
                yield pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in part], "n": [counts[w] for w in part]}, schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in spellings(doc_id, text, options).items():
                    if w not in counts:
                        held += len(w) + 100
                    counts[w] += n
                if held > 1 << 26:
                    yield from out()
                    counts.clear()
                    held = 0
        yield from out()

    texts = documents.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= options.least_count)


class Trie:
    """A compact trie in arrays, nodes in breadth-first order: node 0 is the root, a node's children stand together,
    sorted by their first characters. Node k has the edge text ``chars[at[k]:at[k + 1]]`` and the count of the
    word that ends there (0: none). Characters are Latin-1 codes."""

    def __init__(self, chars: np.ndarray, at: np.ndarray, parents: np.ndarray, counts: np.ndarray):
        self.chars, self.at, self.parents, self.counts = np.append(chars, np.uint8(0)), at.astype(np.int64), parents, counts
        self.size = np.diff(self.at)
        self.kids = np.searchsorted(parents[1:], np.arange(len(parents) + 1)) + 1  # of node k: kids[k] to kids[k + 1]
        self.first = self.chars[self.at[:-1]]
        self.keys = parents[1:].astype(np.int64) * 256 + self.first[1:]
        depth = np.zeros(len(parents), np.int64)
        lo, hi = 0, 1
        while lo < hi:  # level by level
            nlo, nhi = int(self.kids[lo]), int(self.kids[hi])
            depth[nlo:nhi] = depth[parents[nlo:nhi]] + self.size[nlo:nhi]
            lo, hi = nlo, nhi
        self.depth = depth

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        t = build(words, counts)
        return cls(np.frombuffer(b"".join(t[0]), np.uint8), np.cumsum([0, *map(len, t[0])]), np.array(t[1], np.int32), np.array(t[2], np.int64))

    def word(self, node: int) -> str:
        parts = []
        while node > 0:
            parts.append(self.chars[self.at[node] : self.at[node + 1]].tobytes())
            node = int(self.parents[node])
        return b"".join(reversed(parts)).decode("latin-1")

    def child(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes have a child that begins with the character, those children)."""
        if not len(self.keys):
            return np.zeros(len(node), bool), node
        key = node.astype(np.int64) * 256 + char
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[k] == key, k + 1


class Run:
    """Words searched for together: their characters with a zero before and three behind each."""

    def __init__(self, words: list[str]):
        coded = [w.encode("latin-1") for w in words]
        self.length = np.array([len(w) for w in coded], np.int64)
        self.codes = np.frombuffer(b"".join(b"\0" + w + b"\0\0\0" for w in coded), np.uint8)
        self.base = np.cumsum(np.concatenate(([0], self.length + 4)))[:-1] + 1

    def char(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.codes[self.base[word] + i]


def near(trie: Trie, run: Run, block: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, node) for each word of the run and each word of the trie at distance exactly one.

    The words' automata walk the trie together, a block of states at a time and depth first. A state without an edit
    stands at a node and tries all its children; one that has made its edit follows the rest of its word. Deletions
    and insertions in a run of equal characters are made at its beginning, so no word is accepted twice."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(np.arange(len(run.length)), np.zeros(len(run.length), np.int64))]
    while stack:
        word, node = stack.pop()
        if len(word) > block:
            stack += [(word[lo : lo + block], node[lo : lo + block]) for lo in range(0, len(word), block)]
            continue
        d = trie.depth[node]
        here, before = run.char(word, d), run.char(word, d - 1)
        cut = (here != 0) & (here != before)  # the word's character left out
        spent = [(word[cut], node[cut], trie.size[node[cut]], d[cut] + 1)]
        # every child of every state
        many = trie.kids[node + 1] - trie.kids[node]
        each = np.repeat(np.arange(len(word)), many)
        kid = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + trie.kids[node][each]
        word, d, here, before, off = word[each], d[each], here[each], before[each], np.zeros(len(each), np.int64)
        while len(word):
            c = trie.chars[trie.at[kid] + off]
            put, other, same = c != before, (c != here) & (here != 0), c == here
            spent.append((word[put], kid[put], off[put] + 1, d[put]))
            spent.append((word[other], kid[other], off[other] + 1, d[other] + 1))
            word, kid, off, d, before = word[same], kid[same], off[same] + 1, d[same] + 1, here[same]
            over = off == trie.size[kid]
            if over.any():
                stack.append((word[over], kid[over]))
                word, kid, off, d, before = word[~over], kid[~over], off[~over], d[~over], before[~over]
            here = run.char(word, d)
            cut = (here != 0) & (here != before)
            spent.append((word[cut], kid[cut], off[cut], d[cut] + 1))
        follow(trie, run, *(np.concatenate(x) for x in zip(*spent, strict=True)), found)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([w for w, _ in found]), np.concatenate([n for _, n in found])


def follow(trie: Trie, run: Run, word, node, off, i, found) -> None:
    """States that have made their edit: ``off`` characters of the node's edge are read, ``i`` of the word."""
    while len(word):
        over = off == trie.size[node]
        if over.any():
            w, k, at = word[over], node[over], i[over]
            word, node, off, i = word[~over], node[~over], off[~over], i[~over]
            end = (at == run.length[w]) & (trie.counts[k] > 0)
            if end.any():
                found.append((w[end], k[end]))
            has, kid = trie.child(k, run.char(w, at))
            word, node, off, i = np.append(word, w[has]), np.append(node, kid[has]), np.append(off, np.ones(has.sum(), np.int64)), np.append(i, at[has] + 1)
            over = off == trie.size[node]
        go = over | (trie.chars[trie.at[node] + np.minimum(off, trie.size[node] - 1)] == run.char(word, i))
        step = (~over).astype(np.int64)
        word, node, off, i = word[go], node[go], (off + step)[go], (i + step)[go]


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # the first difference lies in [lo, hi)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def build(words: list[str], counts: list[int]) -> tuple[list[bytes], list[int], list[int]]:
    """Edge texts, parents and counts of the compact trie of sorted distinct words, breadth first."""
    labels, parents, ends, depth = [""], [-1], [0], [0]
    path = [0]  # nodes from the root to the last word
    before = ""
    for w, n in zip(words, counts, strict=True):
        k = _common(before, w)
        last = -1
        while depth[path[-1]] > k:
            last = path.pop()
        top = path[-1]
        if depth[top] < k:  # the edge to ``last`` is split: it keeps its end, a new node takes its beginning
            cut = k - depth[top]
            labels.append(labels[last][:cut])
            parents.append(top)
            ends.append(0)
            depth.append(k)
            top = len(labels) - 1
            labels[last] = labels[last][cut:]
            parents[last] = top
            path.append(top)
        if len(w) > k:
            labels.append(w[k:])
            parents.append(top)
            ends.append(n)
            depth.append(len(w))
            path.append(len(labels) - 1)
        else:
            ends[top] = n
        before = w
    kids: list[list[int]] = [[] for _ in labels]
    for i, p in enumerate(parents[1:], 1):
        kids[p].append(i)
    order, place = [0], [0] * len(labels)
    for i in order:  # grows as it is read
        order += sorted(kids[i], key=labels.__getitem__)
    for new, old in enumerate(order):
        place[old] = new
    return [labels[i].encode("latin-1") for i in order], [-1, *(place[parents[i]] for i in order[1:])], [ends[i] for i in order]


_NODES = pa.schema([("label", pa.binary()), ("parent", pa.int32()), ("n", pa.int64())])


def write_shards(words: DataFrame, options: SpellingOptions = SpellingOptions()) -> DataFrame:
    """Cuts words into trie shards: (file, first, words) for each, ``first`` being its smallest word."""
    spark = words.sparkSession
    folder = shared_dir(spark, "tries")
    schema = pa.schema([("file", pa.string()), ("first", pa.string()), ("words", pa.int64())])

    def write(batches):
        import uuid

        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        own: list[str] = []
        counts: list[int] = []

        def shard():
            name = f"{path}/{uuid.uuid4().hex}.arrow"  # of this attempt alone
            columns = build(own, counts)
            with fs.open_output_stream(name) as sink, pa.ipc.new_file(sink, _NODES) as f:
                f.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODES.types, strict=True)], schema=_NODES))
            return pa.RecordBatch.from_pydict({"file": [name], "first": [own[0]], "words": [len(own)]}, schema=schema)

        chars = 0
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own and (len(own) >= options.shard_words or chars + len(w) > options.shard_chars):
                    yield shard()
                    own, counts, chars = [], [], 0
                own.append(w)
                counts.append(n)
                chars += len(w)
        if own:
            yield shard()

    parts = max(1, -(-words.count() // (2 * options.shard_words)))
    ordered = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return staged(ordered.mapInArrow(write, "file string, first string, words long"), "shards")


class Shards:
    """The shards of a vocabulary as a task sees them: a directory, and the few tries that were read last."""

    def __init__(self, folder: str, held: int):
        from pyarrow import fs, parquet

        self.fs, path = file_system(folder)
        files = [f.path for f in self.fs.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
        rows = [r for f in sorted(files) for r in parquet.read_table(self.fs.open_input_file(f)).to_pylist()]
        self.directory = [r["file"] for r in sorted(rows, key=lambda r: r["first"])]
        self.held: OrderedDict[str, Trie] = OrderedDict()
        self.most = held
        self.back = False

    def each(self):
        """(place in the order of words, trie) of all shards; there and back in turn, so that the tries held from one
        run of words are the first that the next one needs."""
        order = list(enumerate(self.directory))
        for k, file in reversed(order) if self.back else order:
            yield k, self.trie(file)
        self.back = not self.back

    def trie(self, file: str) -> Trie:
        if file in self.held:
            self.held.move_to_end(file)
            return self.held[file]
        while len(self.held) >= self.most:
            self.held.popitem(last=False)
        with self.fs.open_input_file(file) as source:
            t = pa.ipc.open_file(source).read_all().combine_chunks()
        labels = t.column("label").chunk(0)
        offsets = np.frombuffer(labels.buffers()[1], np.int32, len(labels) + 1, labels.offset * 4)
        chars = np.frombuffer(labels.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.held[file] = Trie(chars, offsets - offsets[0], t.column("parent").to_numpy(), t.column("n").to_numpy())
        return self.held[file]


def near_words(words: DataFrame, shards: str, options: SpellingOptions = SpellingOptions()) -> DataFrame:
    """(word, n, n_near, best, best_n): the number of near words of each word, and the most frequent of them.

    ``shards``: the folder of the table that ``write_shards`` wrote."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])

    def search(batches):
        all_shards = Shards(shards, options.held_shards)

        def found(own, n):
            run = Run(own)
            many, top, place = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            best: list[str | None] = [None] * len(own)
            for k, trie in all_shards.each():
                word, node = near(trie, run)
                if not len(word):
                    continue
                many += np.bincount(word, minlength=len(own))
                order = np.lexsort((-trie.counts[node], word))
                word, node = word[order], node[order]
                count = trie.counts[node]
                lead = np.concatenate(([True], word[1:] != word[:-1]))
                most = np.repeat(count[lead], np.diff(np.append(np.flatnonzero(lead), len(word))))
                # the shard's most frequent near words that are not behind what other shards have
                wins = (count == most) & ((count > top[word]) | ((count == top[word]) & (k <= place[word])))
                for w, x, c in zip(word[wins].tolist(), node[wins].tolist(), count[wins].tolist(), strict=True):
                    text = trie.word(x)
                    if c > top[w] or k < place[w] or text < best[w]:
                        best[w], top[w], place[w] = text, c, k
            columns = {"word": own, "n": n, "n_near": many, "best": best, "best_n": [int(t) if b is not None else None for t, b in zip(top, best, strict=True)]}
            return pa.RecordBatch.from_pydict(columns, schema=schema)

        own: list[str] = []
        counts: list[int] = []
        chars = 0
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own and (len(own) >= options.run_words or chars + len(w) > options.run_chars):
                    yield found(own, counts)
                    own, counts, chars = [], [], 0
                own.append(w)
                counts.append(n)
                chars += len(w)
        if own:
            yield found(own, counts)

    parts = max(1, -(-words.count() // options.run_words))
    runs = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return runs.mapInArrow(search, "word string, n long, n_near long, best string, best_n long")


def variants(documents: DataFrame, options: SpellingOptions = SpellingOptions()) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word."""
    words = staged(word_counts(documents, options), "words")
    files = write_shards(words, options).inputFiles()
    shards = files[0].rsplit("/", 1)[0] if files else None
    found = near_words(words, shards, options) if shards else words.selectExpr("word", "n", "0L AS n_near", "CAST(null AS string) AS best", "CAST(null AS long) AS best_n")
    enough = F.col("best_n") >= options.ratio * F.col("n")
    table = staged(found.select("word", "n", "n_near", F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")), "near")
    # every round doubles the steps that a root is ahead of its word; forms grow by ``ratio``, so rounds are few
    ahead = staged(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ahead.select(F.col("word").alias("root"), F.col("root").alias("far"))
        stepped = staged(ahead.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        ahead = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            break
    return table.join(ahead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc AS (  -- the checksum's table, from its rule
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
    FROM range(256) AS r(b)),
runs AS (
    SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents WHERE text IS NOT NULL)
    WHERE length(raw) >= 7 GROUP BY ALL),
bytes AS (
    SELECT doc_id, run, n, flatten([CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END FOR c IN string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')]) AS b
    FROM runs),
hashed AS (
    SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes, crc),
spelt AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, near)) AS near FROM pairs GROUP BY word),
formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 10 * w.n THEN b.near END AS form, CASE WHEN b.top >= 10 * w.n THEN b.top END AS form_n
    FROM words w LEFT JOIN best b USING (word)),
chain AS (
    SELECT word, word AS root, 0 AS step FROM formed
    UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) USING (word)
"""
