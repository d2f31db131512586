"""Corpus queries against their SQL twins on the smallest tables."""

import pytest

from tests.compare import assert_same
from tracewright.llm import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert_same(catalog.queries()[name](spark, sf_dir), duck, ORACLES[name])


def test_there_is_a_query_for_each_operator():
    assert {n.split("_")[0] for n in catalog.queries()} == {f"op{i}" for i in range(1, 14)}
