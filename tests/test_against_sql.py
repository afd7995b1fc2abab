"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry
from conftest import SF
from verification.compare import compare, duck

SQL = entry.oracle_sql()
QUERIES = {name: query for name, query in entry.queries().items() if name not in entry.LLM_QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, con, name):
    count, difference = compare(spark, con, SF, name, QUERIES[name], SQL[name])
    assert difference is None, difference
    assert count > 0 or name == "rollback_plan_remaining"  # the small data undid every key


def test_flagship(spark):
    assert entry.entry(spark).count() == 13
