"""Registered queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from . import detection, history_plans, labels_and_scores, models_plans, normalization, report_plans  # noqa: F401  (they register queries)
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
