"""Every core query against its SQL twin on the smallest tables."""

import os

import pandas as pd
import pytest

from loomstone.plans import catalog

DIR = os.environ.get("LOOMSTONE_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(DIR):
        src = f"{DIR}/{name}" + ("/*.parquet" if os.path.isdir(f"{DIR}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{src}'")
    return con


def norm(df):
    def one(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        return f"{float(x):.6f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" and not x.shape else str(x)

    return sorted(tuple(map(one, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
