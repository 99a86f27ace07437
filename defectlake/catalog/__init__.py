"""The registered queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("findings", "reports", "heap", "code", "exports")


def _registries():
    return [import_module(f"defectlake.catalog.{name}").query for name in _MODULES]


def queries() -> dict:
    return {name: fn for registry in _registries() for name, fn in registry.queries.items()}


def oracle_sql() -> dict:
    return {name: sql for registry in _registries() for name, sql in registry.oracle.items()}
