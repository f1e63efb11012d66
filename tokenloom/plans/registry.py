"""Registered queries over the columnar tables and the SQL each is held against."""

from __future__ import annotations

from tokenloom.plans import documents, ledger, nested, spans  # noqa: F401  (register their queries)
from tokenloom.plans.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
