"""Every catalogue query against its SQL in DuckDB, on the whole tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, sf, name):
    statements = entry.oracle_sql()
    if name not in statements:
        pytest.skip("no SQL form")
    assert compare(spark, con, entry.queries()[name], statements[name], sf) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
