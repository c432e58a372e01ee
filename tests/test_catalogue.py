"""Every query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

QUERIES, STATEMENTS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def sql(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(spark, data, sql, name):
    ours = QUERIES[name](spark, data).toPandas()
    assert len(ours)
    assert differences(ours, sql.execute(STATEMENTS[name]).df()) == ""


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
