"""Operators for training-data pipelines: packing, scans, decontamination, formatting, counting,
language identification, near-duplicate detection, binary output, audio, privacy, vector links, fill-in-the-middle
and resampling.

Nothing outside this folder imports it. ``queries`` and ``oracle_sql`` list what it registers.
"""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "packing", "secret_scan", "decontaminate", "chat", "token_counts",
    "language", "near_dup", "records", "audio", "privacy", "vector_links", "fill_middle", "resample",
)


def queries() -> dict:
    """One query per operator."""
    found: dict = {}
    for name in _MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict:
    """DuckDB SQL of the operators that SQL can state."""
    found: dict = {}
    for name in _MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), "ORACLE_SQL", {})
    return found
