"""Each query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from spanloom import catalog, catalog_documents  # noqa: F401 - the second adds its queries to the first

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    assert rows == sorted(map(repr, want.fetchall()))


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
