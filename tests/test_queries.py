"""Every registered query against its SQL form on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from checks.compare import connect, difference

QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_small):
    return connect(sf_small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_small, con, name):
    df = QUERIES[name](spark, sf_small)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark, sf_small):
    assert entry_points.entry(spark).count() == 4


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
