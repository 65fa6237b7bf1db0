"""Spelling variants, whitening and the quality classifier against brute force, with their edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from smoothlake.llm import quality, spelling, whitening

DOCS = "doc_id long, text string, lang string, word string, n long, root string"


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, least_count=2):
    counts: Counter = Counter()
    upper = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for doc_id, text in rows:
        run = ""
        for c in (text or "").translate(upper) + "\n":
            if "a" <= c <= "z" or 0xC0 <= ord(c) <= 0xFF:
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                if len(word) >= 7:
                    counts[word] += 1
            run = ""
    words = {w: n for w, n in counts.items() if n >= least_count}
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [form, w, n, len(near), words[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {(w, *v) for w, v in out.items()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    stock = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 9))) for _ in range(40)]
    stock += [w[:3] + w[4:] for w in stock[:9]] + ["ÿ" + w for w in stock[:9]]
    weights = [rng.choice((1, 1, 30, 400)) for _ in stock]
    rows = [(i, " ".join(rng.choices(stock, weights, k=60)) + "! " + rng.choice(("Ünïcode×÷ß", "日本 letters", "STRAßEN ÀÉÎabcdefg"))) for i in range(150)]
    chain = [(1000, "mnopqrst " * 40), (1001, "mnopqrst " * 40), (1002, "mnopqrsu " * 1200), (1003, "mnopqrsu " * 1200)] + [(i, "anopqrst") for i in (1004, 1005, 1006)]
    return rows + chain + [rows[3], rows[3], (7, None), (8, ""), (None, "aaaaaaa aaaaaaa aaaaaab"), (9, "x" * 40_000), (10, "x" * 40_000 + " " + "x" * 39_999), (10, "x" * 39_999), (11, " ".join(rng.choices(stock, k=20_000)))]


@pytest.mark.parametrize("options", [spelling.SpellingOptions(), spelling.SpellingOptions(shard_words=7, run_words=5, held_shards=2)])
def test_variants_equal_brute_force(spark, texts, options):
    docs = spark.createDataFrame([(i, t, "x", "clash", 1, "clash") for i, t in texts], DOCS).repartition(5)
    got = [tuple(r) for r in spelling.variants(docs, options).collect()]
    want = brute_variants(texts)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None, "x", "y", 1, "z"), (2, "no long word", "x", "y", 1, "z")], DOCS)).collect() == []


def test_tries_hold_their_words_and_find_neighbours():
    rng = random.Random(2)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abß") for _ in range(rng.randint(1, 7))) for _ in range(50)})
        trie = spelling.Trie.of(words, list(range(1, len(words) + 1)))
        ends = np.flatnonzero(trie.counts)
        assert sorted((trie.word(k), int(trie.counts[k])) for k in ends) == [(w, i + 1) for i, w in enumerate(words)]
        own = [*words, "abab", "ßßßßß", "b"]
        for block in (7, 4096):
            at, node = spelling.near(trie, spelling.Run(own), block)
            got = sorted((own[i], trie.word(k)) for i, k in zip(at.tolist(), node.tolist(), strict=True))
            assert got == sorted((w, x) for w in own for x in words if one_edit(x, w))


VECTORS = "vec_id long, embedding array<float>, label int, x int, component string"


def brute_whitening(vectors):
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors[:, :4] / np.sqrt(values[:4]), values[:4] / values.sum()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(300, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]).astype(np.float32)
    v[200:] = v[100]  # a hot vector
    good = [(int(i), [float(c) for c in row], 1, 5, "clash") for i, row in enumerate(v)]
    bad = [(900, None, 1, 1, "c"), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1, 1, "c"), (902, [float("nan")] * 6, 1, 1, "c"), (903, [float("inf")] * 6, 1, 1, "c"), (904, [], 1, 1, "c"), (905, [1.0, 2.0], 1, 1, "c")]
    repeated = [(good[7][0], good[8][1], 1, 1, "c"), (None, good[9][1], 1, 1, "c"), good[5]]
    got = whitening.whiten(spark.createDataFrame(good + bad + repeated, VECTORS).repartition(4)).toPandas()
    assert len(got) == 4 * 303 and not got.vec_id.ge(900).any()
    n, deviation, white, explained = brute_whitening(v)
    alone = got[got.vec_id.between(10, 299)].sort_values(["vec_id", "component"])
    assert (got.n == n).all() and (alone.deviation.to_numpy() == np.repeat(deviation[10:], 4)).all()
    found = alone.whitened.to_numpy().reshape(-1, 4)
    signs = np.sign((found * white[10:]).sum(axis=0))
    assert np.abs(found * signs - white[10:]).max() < 1e-9
    assert np.allclose(alone.explained.to_numpy().reshape(-1, 4), explained, rtol=1e-9) and got.identity_error.max() < 1e-9


def test_whitening_of_little(spark):
    table = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert table([]) == []
    assert table([(1, None, 1, 1, "c"), (2, [], 1, 1, "c")]) == []
    assert table([(i, [1.0, 2.0], 1, 1, "c") for i in range(5)]) == []
    line = table([(i, [float(i), 2.0 * i], 1, 1, "c") for i in range(5)])
    assert len(line) == 5 and {r.component for r in line} == {1}  # the second has no variance
    huge = table([(1, [3e38, 0.0], 1, 1, "c"), (2, [-3e38, 1.0], 1, 1, "c")])
    assert huge and all(r.deviation is None for r in huge)


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[2**50, -(2**50)], [3, 5]])
    assert whitening.deviations(x, 10, [7, 9]) == [sum((10 * int(v) - s) ** 2 for v, s in zip(r, (7, 9), strict=True)) for r in x.tolist()]


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        stock = ("the", "story", "of", "a", "river", "and", "its", "town") if good else ("BUY", "now", "click", "the", "cheap", "of", "pills")
        mark = " " if good or rng.random() < 0.3 else "!! "
        rows.append((i, mark.join(rng.choices(stock, k=rng.randint(5, 60))), "x", "w", 1, "r"))
        labels.append((i, int(good), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_quality_learns_and_keeps_the_edges(spark):
    rows, labels = labelled(random.Random(6), 600)
    rows += [(None, "the story of a town", "x", "w", 1, "r"), (700, None, "x", "w", 1, "r"), (701, "", "x", "w", 1, "r"), (702, "the river " * 30_000, "x", "w", 1, "r"), (703, "日本語 BUY!! now!! cheap!!", "x", "w", 1, "r")] + [rows[0]] * 300
    labels += [labels[0]] * 50 + [(None, 1, 0), (700, 0, 0), (702, 1, 0), (702, 0, 0), (703, None, 0), (701, 7, 0)]
    docs, table = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    got = quality.judge(docs, table).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(int(i)).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out, strict=True) if i == i)
    truth = dict((i, q) for i, q, _ in labels[:600])
    held = got[got.held_out & got.doc_id.lt(600)]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.97
    assert got[got.doc_id == 0].score.nunique() == 1 and got[got.doc_id == 703].predicted.item() == 0 and got[got.doc_id == 702].predicted.item() == 1
    same = got[got.doc_id.isin([700, 701])].score
    assert same.nunique() == 1


def test_quality_ignores_labels_held_out(spark):
    rows, labels = labelled(random.Random(7), 300)
    docs = spark.createDataFrame(rows, DOCS)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    a, b = (quality.judge(docs, spark.createDataFrame(x, LABELS)).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert np.allclose(a.score, b.score, atol=1e-9)


def test_quality_without_two_classes(spark):
    rows, labels = labelled(random.Random(8), 30)
    docs = spark.createDataFrame(rows, DOCS)
    ones = quality.judge(docs, spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS)).toPandas()
    assert ones.score.nunique() == 1 and ones.score[0] > 0.9
    assert (quality.judge(docs, spark.createDataFrame([], LABELS)).toPandas().score == 0.5).all()
    assert quality.judge(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).collect() == []


def test_blocks_reach_the_optimum_of_one_solver(spark):
    """Eight blocks and one give weights whose objectives agree with a plain solver's to the duality gap."""
    rows, labels = labelled(random.Random(9), 300)
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    o = quality.QualityOptions(bits=10, cost=0.1, gap=0.01, rounds=80)
    texts = quality.sample(docs, table, o)
    ratios, by_fold = quality.log_ratios(texts, o)
    own = texts.toPandas()
    x = np.zeros((len(own), (1 << 10) + 1))
    for i, b in enumerate(own["ids"]):
        at = np.frombuffer(b, np.uint32)
        x[i, at] = quality._unit(ratios[-1][at])
    x[:, -1] = 1
    y = own["y"].to_numpy() * 2 - 1
    present = np.array([[(np.frombuffer(b, np.uint32) == j).any() for b in own["ids"]] for j in range(0, 1024, 97)])
    for j, has in zip(range(0, 1024, 97), present, strict=True):
        p, q = ((has & (y == s)).sum() + 1 for s in (1, -1))
        total = [sum(len(b) // 4 for b, s in zip(own["ids"], y, strict=True) if s == t) + 1024 for t in (1, -1)]
        assert np.isclose(ratios[-1][j], np.log(p / total[0]) - np.log(q / total[1]))
    value = lambda w: 0.5 * w @ w + 0.1 * np.maximum(0, 1 - y * (x @ w)).sum()
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    for _ in range(1000):
        for i in range(len(y)):
            new = min(max(alpha[i] + (1 - y[i] * (x[i] @ w)) / (x[i] @ x[i]), 0), 0.1)
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    for size in (8192, 40):
        blocks = quality._blocks(texts, int(by_fold.sum()), quality.QualityOptions(bits=10, block_texts=size))
        problems, gaps = quality.descend(blocks, ratios, o)
        assert max(gaps) <= 0.01 and -1e-9 <= value(problems[-1].weights) / value(w) - 1 <= 0.01


def brute_neighbours(rows, is_query, k=5):
    """Per query row (id and vector): its neighbours by the computed cosine, ties by id."""
    ids = np.array([i for i, _ in rows])
    v = np.array([list(map(float, x)) for _, x in rows])
    norms = np.sqrt(np.einsum("ij,ij->i", v, v))
    out = []
    for i, x in {(i, tuple(x)) for i, x in rows if is_query(i)}:
        q = np.array(x, float)
        score = np.einsum("ij,ij->i", v, np.broadcast_to(q, v.shape)) / (norms * np.sqrt(np.einsum("ij,ij->i", q[None], q[None])))
        near = sorted((-s, j) for s, j in zip(score.tolist(), ids.tolist(), strict=True) if j != i)[:k]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)


def test_near_parallel_vectors_come_in_the_order_of_their_scores(spark):
    """Copies whose components differ in the last bit: distances cannot tell them apart, computed cosines can."""
    from smoothlake.llm import vp_search

    rng = np.random.default_rng(12)
    rows = []
    for base in rng.normal(size=(3, 64)).astype(np.float32):
        for _ in range(400):
            x = base.copy()
            for at in rng.integers(0, 64, rng.integers(1, 6)):
                x[at] = np.nextafter(x[at], np.float32(9), dtype=np.float32)
            rows.append((len(rows), x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    for o in (vp_search.SearchOptions(leaf=16), vp_search.SearchOptions(shard=300, leaf=32, block=5)):
        got = vp_search.search(df, df.vec_id % 10 == 0, o).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_neighbours(rows, lambda i: i % 10 == 0)


def test_rows_with_one_query_id_are_ranked_each_for_itself(spark):
    from smoothlake.llm import vp_search

    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(0, rng.normal(size=8).tolist()), rows[0], rows[10], (20, rng.normal(size=8).tolist())]
    other = [(70, [1.0, 2.0]), (71, [1.0] * 9), (72, [])]
    df = spark.createDataFrame(rows + other, "vec_id long, embedding array<double>")
    got = vp_search.search(df, df.vec_id % 10 == 0, vp_search.SearchOptions(leaf=4)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_neighbours(rows, lambda i: i % 10 == 0)
