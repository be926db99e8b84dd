"""Every query with SQL gives the SQL's rows; all share one set of facts."""

import duckdb
import pytest

from factgraph.plans import catalog
from factgraph.sources.facts import BASE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shared(spark):
    return catalog.Facts(spark, SF)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(shared, con, name):
    df = catalog.BUILDS[name](shared)
    want = con.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, df.select(columns).collect()), key=key) == sorted(want.fetchall(), key=key)
