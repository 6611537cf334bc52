"""All queries of the engine, by name."""

from __future__ import annotations

from inkloom.plans import queries_audit, queries_books, queries_lines, queries_links

MODULES = [queries_lines, queries_audit, queries_links, queries_books]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
