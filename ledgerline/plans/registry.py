"""A small registry: a query's function and its SQL are written side by side."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None, name: str | None = None):
        def add(f: Callable) -> Callable:
            queries[name or f.__name__] = f
            if sql is not None:
                oracles[name or f.__name__] = sql
            return f

        return add

    return queries, oracles, query
