"""Every engine query against its DuckDB oracle."""

import duckdb
import pytest
from conftest import rows_of, table_views

from fascicle.plans import oracles
from fascicle.plans.queries import queries

SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    table_views(c, sf)
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf, con, name):
    got = queries()[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
