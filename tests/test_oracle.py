"""Every registered query against its oracle SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, small, con, name):
    problem, _ = compare(QUERIES[name](spark, small), con, ORACLES[name])
    assert problem is None


def test_registries_agree():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
