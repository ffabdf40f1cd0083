"""All queries of the library, and the SQL each must equal."""

from __future__ import annotations

from tidemark.plans import more_queries  # noqa: F401  registers its queries
from tidemark.plans import queries as _q


def queries() -> dict:
    return dict(_q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_q.SQL)
