"""Every query with SQL against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from millrace import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLES:
        assert len(got)
        return
    want = duck.sql(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[cols].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
