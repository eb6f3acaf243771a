"""Every query that SQL can express gives the rows of the SQL, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from grantlens.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    return float(x) if isinstance(x, decimal.Decimal) else x


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    relation = duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    order = [relation.columns.index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in order]) for r in relation.fetchall())
    assert got == want


def test_every_query_has_rows(spark):
    assert catalog.QUERIES["rfa_regression"](spark, DATA).columns == ["term", "beta", "pct_diff", "reference"]


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1
