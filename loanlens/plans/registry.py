"""The registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import audits, extraction, history, marks, migration, overlap, studies

_MODULES = (marks, history, migration, overlap, studies, extraction, audits)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
