"""A decorator that files a query and its SQL under the function's name."""

from __future__ import annotations

from collections.abc import Callable


def registrar(queries: dict, oracles: dict) -> Callable:
    def query(sql: str | None = None) -> Callable:
        def file(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return file

    return query
