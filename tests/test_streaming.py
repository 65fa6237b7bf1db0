"""Sums of a stream that outlive its driver: cut off anywhere, every batch counts once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from smoothlake.operators.gam import gam
from smoothlake.streaming.accumulate import SLOTS, StreamingGam


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(600).select((F.col("id") % 97 / 97).alias("x"), (F.sin(F.col("id") % 97 / 15) + F.cos(F.col("id") * 7) / 3).alias("y"), (F.col("id") % 6).alias("part"))


class Cut(RuntimeError):
    """The driver is gone."""


def one_shot(table):
    return gam("y ~ s(x, k=6, bs='cr')", table)


def test_killed_and_restarted_stream_gives_the_one_shot_fit(spark, table, tmp_path):
    source, state, checkpoint = (str(tmp_path / n) for n in ("source", "state", "checkpoint"))
    table.coalesce(1).write.partitionBy("part").parquet(source)
    schema = table.drop("part").schema

    def feed(model):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
        return model.attach(stream, checkpoint, available_now=True)

    def run(model, cut_at, when):
        """Feeds a model whose driver dies in the commit of one version, before or after the row is written."""
        plain = model._commit

        def commit(*a):
            if when == "before" and model.version + 1 == cut_at:
                raise Cut
            plain(*a)
            if when == "after" and model.version == cut_at:
                raise Cut

        model._commit = commit
        query = feed(model)
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001 - the cut comes back wrapped
            assert cut_at
        return model

    formula = "y ~ s(x, k=6, bs='cr')"
    run(StreamingGam(formula, table, state=state), 2, "before")
    run(StreamingGam(formula, state=state), 4, "after")  # the stream does not know that version 4 was written
    run(StreamingGam(formula, state=state), 5, "before")
    last = run(StreamingGam(formula, state=state), None, None)
    assert last.version == 6 and last.last == 5
    again = StreamingGam(formula, state=state)
    assert again.n == 600 and np.array_equal(again.g, last.g)
    want, got = one_shot(table), again.solve()
    assert got["n"] == 600 and got["edf"] == pytest.approx(want.model_edf(), abs=1e-3) and got["scale"] == pytest.approx(want.scale, rel=1e-6)
    assert np.allclose(got["beta"], want.beta, atol=1e-4)


def test_versions_take_turns_and_broken_rows_are_passed_over(spark, table, tmp_path):
    state = str(tmp_path / "state")
    model = StreamingGam("y ~ x", table, state=state)
    for i in range(5):
        model.add(table.where(F.col("part") == i), i)
    model.add(table.where("part = 4"), 4)  # handed in once more
    assert model.n == 500 and len(list((tmp_path / "state").glob("slot=*"))) == SLOTS
    row = spark.read.parquet(f"{state}/slot={5 % SLOTS}").collect()[0].asDict() | {"n": 1.0}
    spark.createDataFrame([row], "version long, batch long, formula string, design binary, g binary, b binary, zz double, n double, checksum long").write.mode("overwrite").parquet(f"{state}/slot={5 % SLOTS}")
    before = StreamingGam("y ~ x", state=state)
    assert before.version == 4 and before.last == 3 and before.n == 400
    before.add(table.where("part = 4"), 4)
    assert before.n == 500 and np.allclose(before.g, model.g)


def test_what_has_no_state_is_refused(spark, table, tmp_path):
    model = StreamingGam("y ~ x", table)
    with pytest.raises(ValueError):
        model.attach(spark.readStream.format("rate").load(), str(tmp_path))
    with pytest.raises(ValueError):
        StreamingGam("y ~ x")
    StreamingGam("y ~ x", table, state=str(tmp_path / "s")).add(table, 0)
    with pytest.raises(ValueError):
        StreamingGam("y ~ 1", state=str(tmp_path / "s"))
    model.add(table)
    model.add(table)  # without an id every batch is added
    model.add(table.where("false"), 7)
    assert model.n == 1200 and model.last == 7
