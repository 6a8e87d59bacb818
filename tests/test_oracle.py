"""Every query against the same in SQL, run by DuckDB."""

import pytest
from compare import duck, rows_of

from quillstack.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    found = con.execute(registry.ORACLE_SQL[name])
    want = rows_of([d[0] for d in found.description], found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_query_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.collect() is not None
