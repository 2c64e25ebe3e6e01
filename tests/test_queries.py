"""Every core query runs on the smallest tables and equals its SQL."""

import glob
import os

import pytest

from foldmark.plans import catalog

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def text(v):
    return "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


def compare(spark, duck, query, sql):
    df = query(spark, DATA)
    got = sorted(tuple(text(r[c]) for c in sorted(df.columns)) for r in df.collect())
    ran = duck.execute(sql)
    names = [c[0] for c in ran.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    assert sorted(df.columns) == sorted(names)
    assert got == sorted(tuple(text(r[k]) for k in order) for r in ran.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).columns


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES
