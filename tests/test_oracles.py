"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from tests.compare import assert_same
from tracewright.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert_same(catalog.queries()[name](spark, sf_dir), duck, ORACLES[name])


def test_every_query_is_listed():
    missing = set(catalog.queries()) - set(ORACLES)
    assert missing == {"detector_alerts", "m2_group_split", "m6_m7_forest_branch", "d6_rules_only_branch", "m8_sequence_branch", "m10_m13_fusion"}
