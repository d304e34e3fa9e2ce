"""All queries of the library outside optional subpackages."""

from __future__ import annotations

from folioscope.plans import evidence, forms, relational, reports

PLANS = (relational, evidence, reports, forms)


def queries() -> dict:
    return {name: query for plan in PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
