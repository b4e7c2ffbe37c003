"""Every query of the engine by name, and its SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("graph_queries", "search_queries", "code_queries")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__package__}.{m}").ORACLE_SQL.items()}
