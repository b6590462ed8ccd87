"""All registered queries of the demand operators, and their SQL."""

from __future__ import annotations

from plaintide.plans import files, streams, records, rules, scored, texts  # noqa: F401  they register their queries
from plaintide.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
