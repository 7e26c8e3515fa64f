import pytest
from oracle import compare

from stratoscope import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(name, spark, sf):
    compare(queries.QUERIES[name], queries.SQL[name], spark, sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(name, spark, sf):
    """Queries without SQL give rows, the same ones each time, without a null key."""
    first, again = ([tuple(map(repr, r)) for r in queries.QUERIES[name](spark, sf).collect()] for _ in range(2))
    assert first and sorted(first) == sorted(again)


def test_entry(spark):
    import __spark_entry__ as entry

    made = entry.entry(spark)
    assert made.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
