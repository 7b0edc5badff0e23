"""Everything registered, in one place."""

from __future__ import annotations

from tidemark.workloads import (  # noqa: F401
    aggregate_queries,
    calendar_queries,
    flow_queries,
    join_queries,
    policy_queries,
    quality_queries,
    rule_queries,
    scan_queries,
)
from tidemark.workloads.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(sorted(ORACLES.items()))
