"""Every registered query against its SQL on a small scale, whatever subpackages are there."""

import duckdb
import pytest

import __spark_entry__
from smoothlake import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_equals_sql(spark, db, name):
    mine, want = q.QUERIES[name](spark, SF).toPandas(), db.execute(q.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(mine.columns) == cols
    mine, want = (t[cols].sort_values(cols).reset_index(drop=True) for t in (mine, want))
    assert len(mine) == len(want)
    for c in cols:
        if mine[c].dtype.kind == "f":
            assert ((mine[c] - want[c]).abs() <= 1e-6 * want[c].abs() + 2e-6).all(), c
        else:
            assert (mine[c].astype(str) == want[c].astype(str)).all(), c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 50
