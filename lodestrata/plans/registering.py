"""A table of queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(query: Callable) -> Callable:
            self.queries[name] = query
            if sql:
                self.oracle[name] = sql
            return query

        return add
