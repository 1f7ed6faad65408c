"""Every registered query against its SQL (or, without SQL, that it yields rows)."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data_dir, con, name):
    df = QUERIES[name](spark, data_dir)
    if name in SQL:
        assert difference(df, con, SQL[name]) == ""
    else:
        assert not df.isEmpty()


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).columns[0] == "date"
