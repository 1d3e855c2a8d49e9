"""Every registered query against DuckDB on the smallest data folder."""

import pytest
from harness import compare, connect

import __spark_entry__

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, SF_DIR).count() > 0
        return
    difference, _ = compare(spark, duck, QUERIES[name], ORACLES[name], SF_DIR)
    assert difference == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
