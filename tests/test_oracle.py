"""Every registered query beside its SQL on the smallest tables; the others must return rows."""

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def connection(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, small, connection, name):
    assert difference(spark, connection, small, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_returns_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 4
