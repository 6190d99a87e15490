"""Queries against their SQL, and the whole pipeline."""

import pytest

from siftwright.llm import queries as q
from tests.conftest import assert_same


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert_same(q.queries()[name](spark, sf_dir).toPandas(), duck.execute(q.oracle_sql()[name]).df())


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in q.queries()] == list(range(1, 14))
