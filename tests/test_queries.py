import __spark_entry__ as entry
import pytest
from turnsieve.plans import queries as core

from .oracle import agree, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_equals_its_sql(name, spark, con, data):
    agree(core.QUERIES[name], core.ORACLE[name], spark, con, data)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_query_without_sql_runs_twice_alike(name, spark, data):
    first, again = (sorted(map(str, core.QUERIES[name](spark, data).collect())) for _ in range(2))
    assert first == again


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
