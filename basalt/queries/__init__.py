"""Queries over the standard tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from . import changes, code, domain, families, functions, joins, rows, semantic, streams, surface, tables, views
from .registry import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["changes", "code", "domain", "families", "functions", "joins", "oracle_sql", "queries", "rows", "semantic", "streams", "surface", "tables", "views"]
