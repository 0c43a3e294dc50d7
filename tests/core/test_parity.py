"""Every engine query against its SQL on the smallest tables."""

import pytest
from conftest import SMALL
from parity import connect, same

from tracelode.plans import registry


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_parity(spark, db, name):
    same(registry.QUERIES[name](spark, SMALL), db, registry.ORACLE_SQL[name])


def test_every_query_runs_without_sql(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE_SQL):
        assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
