import pytest

from cubewright import queries
from tests.against_sql import SF_DIR, assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_are_those_of_the_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SF_DIR), con, queries.SQL[name])


def test_every_query_has_its_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["scenario", "measure", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
