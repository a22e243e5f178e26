"""A tiny registry: one place for a query and its oracle."""

from __future__ import annotations

import functools
from collections.abc import Callable

from lodestream.session import ship


class Registry:
    """Collects queries by operator id; ``sql`` is the DuckDB text that must give the same rows."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def put(query: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")

            @functools.wraps(query)
            def run(spark, sf_dir):
                ship(spark)
                return query(spark, sf_dir)

            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return query

        return put
