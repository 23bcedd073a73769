"""Every registered query against its SQL, on the small data set."""

import pytest

import __spark_entry__ as entry_module
from oracle import compare, connect
from slotlake.showcase import all_queries

QUERIES = all_queries()


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    fn, sql = QUERIES[name]
    problem, rows = compare(spark, duck, name, fn, sql, sf_dir)
    assert not problem
    assert rows > 0


def test_contract(spark):
    assert entry_module.queries().keys() >= QUERIES.keys()
    assert entry_module.oracle_sql().keys() <= entry_module.queries().keys()
    assert entry_module.entry(spark).count() > 0
