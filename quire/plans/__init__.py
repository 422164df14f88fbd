"""Queries over the tables of a data folder, and their SQL.

A plan module has ``QUERIES`` (name to function of session and folder) and
``SQL`` (name to DuckDB SQL with the same rows, where SQL can express them).
"""

from __future__ import annotations

import importlib
import pkgutil


def modules() -> list:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name)]


def queries() -> dict:
    return {name: f for m in modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in modules() for name, q in m.SQL.items()}
