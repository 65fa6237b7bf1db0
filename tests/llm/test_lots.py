"""Benchmark lots: equal results however a benchmark is dealt, items with one id, and the recall of paraphrases."""

import random

import pytest

from smoothlake.llm import decontaminate
from smoothlake.llm._common import WordHashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, lot long"


def planted(seed=3):
    """Documents that hold items word by word, with words replaced, or not at all."""
    rng = random.Random(seed)
    common = [f"word{i}" for i in range(400)]
    say = lambda n, stock: " ".join(rng.choices(stock, k=n))
    items = [(i, say(rng.randint(20, 40), common + [f"rare{i}x{j}" for j in range(60)]) + f". The answer{i} is number {i} of {i * 7}.") for i in range(60)]
    docs = []
    for i in range(240):
        parts = [say(rng.randint(30, 120), common), say(rng.randint(30, 120), common)]
        if i % 4 < 3:
            body, answer = items[i % 60][1].split(". ")
            kept = body if i % 4 == 0 else " ".join(w if rng.random() > 0.32 else rng.choice(common) for w in body.split())
            parts.insert(1, f"{kept}. {answer}")
        docs.append((i, ". ".join(parts)))
    return docs, items


def brute(docs, items, o):
    hashes = WordHashes()
    known = [decontaminate.item_of(i, t, hashes) for i, t in items]
    out = {}
    for d, text in docs:
        words = hashes.of(text).tolist()
        for x in known:
            got = decontaminate.verified(x, words, o)
            if got and got > out.get((d, x.item_id), (0.0, False)):
                out[d, x.item_id] = got
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = planted()
    return docs, items, spark.createDataFrame([(i, t, "en", "s", 1, "clash", 9) for i, t in docs], DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(2)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_paraphrases_are_found(tables):
    docs, items, df, bench = tables
    o = decontaminate.DecontaminationOptions()
    want = brute(docs, items, o)
    light = {k for k, (share, _) in want.items() if 0.55 <= share <= 0.85}
    got = {(d, i): share for d, i, share, _ in rows(decontaminate.contaminated(df, bench, o))}
    assert len(light) > 60 and len(light & got.keys()) >= 0.9 * len(light), len(light & got.keys()) / len(light)
    exact = {k for k, (share, _) in want.items() if share == 1.0}
    assert len(exact) >= 60 and exact <= got.keys()
    assert got.keys() <= want.keys()  # nothing that whole texts would not confirm


@pytest.mark.parametrize("items_per_pass,run", [(7, 2000), (60, 1 << 24), (1, 9000)])
def test_lots_and_runs_do_not_change_what_is_found(tables, items_per_pass, run):
    _, _, df, bench = tables
    o = decontaminate.DecontaminationOptions(items_per_pass=items_per_pass, run=run, held=3, columns=2048, rank=64)
    all_ = rows(decontaminate.contaminated(df, bench, decontaminate.DecontaminationOptions(columns=2048, rank=64)))
    got = rows(decontaminate.contaminated(df, bench, o))
    assert {r[:2] for r in got} >= {r[:2] for r in all_ if r[2] == 1.0}
    assert len({r[:2] for r in got} ^ {r[:2] for r in all_}) <= 0.05 * len(all_)  # a lot's basis is its own
    kept = {r.doc_id for r in decontaminate.keep_clean(df, bench, o).collect()}
    # sums of floats come in any order, so a cosine at the threshold may fall on either side in two runs
    assert len(kept ^ ({d for d in range(240)} - {r[0] for r in got})) <= 3 and not kept & {r[0] for r in got if r[2] == 1.0}


def test_items_with_one_id_are_reported_once(spark, tables):
    docs, items, df, _ = tables
    text = items[0][1]
    several = [(5, text), (5, "other words that are nowhere at all"), (5, text.split(". ")[0]), (None, text), (None, text + " more"), (6, None), (7, "..."), (5, text)]
    bench = spark.createDataFrame(several, "item_id long, text string")
    for o in (decontaminate.DecontaminationOptions(), decontaminate.DecontaminationOptions(items_per_pass=1, columns=1024)):
        got = [tuple(r) for r in decontaminate.contaminated(df.where("doc_id = 0"), bench, o).collect()]
        assert sorted(((i or 0), s) for _, i, s, _ in got) == [(0, 1.0), (5, 1.0)]
    nothing = spark.createDataFrame([(1, None), (2, " . ")], "item_id long, text string")
    assert decontaminate.contaminated(df, nothing).count() == 0 and decontaminate.keep_clean(df, nothing).count() == 240
