"""Every registered query against its SQL on DuckDB, and the contract of the entry module."""

import pytest

from burrstone import registry
from tests import oracle

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        oracle.assert_same(df, duck, SQL[name])
    else:
        assert df.count() >= 0


def test_entry(spark, duck):
    import __spark_entry__ as entry

    oracle.assert_same(entry.entry(spark), duck, SQL["tri_leftdeep"])
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
