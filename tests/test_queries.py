"""Every registered query against its SQL on DuckDB."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, sf_dir, key):
    if key in ORACLE:
        assert compare(key, QUERIES[key](spark, sf_dir), con, ORACLE[key]) is None
    else:
        assert QUERIES[key](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
