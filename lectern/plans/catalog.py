"""All queries and their SQL."""

from __future__ import annotations

from lectern.plans import evaluate, prepare, retrieve

MODULES = (prepare, retrieve, evaluate)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
