import pytest
from oracle import compare

import corpus_pipeline
from stratoscope.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(name, spark, sf):
    compare(queries.QUERIES[name], queries.SQL[name], spark, sf)


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5
