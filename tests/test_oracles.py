"""Every registered query against its SQL check, on the smallest tables."""

import pytest
from check import check, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    diff, rows, _, _ = check(spark, con, name, QUERIES, ORACLES, SF)
    assert diff is None
    assert rows or name in ORACLES


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns
