"""Every query with SQL is compared with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from kinlink.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return c


def rows(data):
    return sorted(tuple("%.6g" % v if isinstance(v, float) else str(v) for v in r) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    assert rows(df.select(cols).collect()) == rows(duck.sql(f"select {', '.join(cols)} from ({registry.oracle_sql()[name]})").fetchall())
