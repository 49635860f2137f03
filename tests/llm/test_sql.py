"""Every operator's query against its SQL on the smallest tables."""

import pytest
from docgraph.llm import queries

from .helpers import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, name):
    same(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


def test_one_query_an_operator():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
