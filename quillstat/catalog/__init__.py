"""Registered queries: one for each operator on the shared tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

_PARTS = ("metrics", "preprocessing", "selection", "learning", "models", "composed", "solved")


def queries() -> dict:
    return {name: q for part in _PARTS for name, q in import_module(f"{__name__}.{part}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for part in _PARTS for name, q in import_module(f"{__name__}.{part}").SQL.items()}
