"""Every registered query against its SQL, over whole (small) tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, differences

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folder, con, name):
    assert differences(spark, con, folder, QUERIES[name], ORACLES[name], empty_ok=True) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, folder, name):
    QUERIES[name](spark, folder).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
