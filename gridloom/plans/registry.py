"""Query registry: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Queries by name, with the DuckDB text that gives the same rows where there is one."""

    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, query: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = query
        if oracle:
            self.oracles[name] = oracle

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        """Decorator form of add()."""

        def register(fn: Query) -> Query:
            self.add(name, fn, oracle)
            return fn

        return register
