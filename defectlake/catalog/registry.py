"""Registration of queries next to the SQL that must give the same rows."""

from __future__ import annotations


class Registry:
    """Queries of one catalog module and their SQL."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        """Register a function under its name; without ``sql`` only its rows are checked."""

        def add(fn):
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.oracle[fn.__name__] = sql
            return fn

        return add
