"""The pipeline: every stage on what its predecessor kept, and the registered queries."""

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import DOCS, corpus


def test_stages_compose(spark, tmp_path):
    rows = corpus()
    leak = " ".join(f"leaked{i}" for i in range(25))
    rows.append((500, rows[1][1] + " other words " + leak, "en", "s", 1, "c", "c", 1))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.count())
        assert set(docs.columns) == {c.split()[0] for c in DOCS.split(", ")}
    assert kept[0] - kept[1] == 5 and kept[2] < kept[1] and kept[2] - kept[3] == 1
    ids = {r.doc_id for r in docs.collect()}
    assert 500 not in ids and 1 in ids and 140 not in ids and 141 not in ids
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1


def test_tables_with_nothing_in_them(spark, tmp_path):
    good = [r for r in corpus() if r[0] is not None and r[0] < 40]
    nulls = [(i, None, None, None, None, None, None, None) for i in range(5)] + [(None,) * 8]
    items = [(1, " ".join(f"leaked{i}" for i in range(25)))]
    cases = {"empty": ([], items), "nulls": (nulls, items), "no_items": (good, []), "null_items": (good, [(1, None), (None, None)])}
    for name, (rows, bench) in cases.items():
        d = tmp_path / name
        spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        packed = corpus_pipeline.run(spark, str(d)).collect()
        assert (len({r.doc_id for r in packed}) > 20) == (rows is good), name
