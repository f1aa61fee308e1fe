"""The registered queries and their equivalent SQL, and a registry of operators by category and name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


class Registry:
    """Named entries by category; another entry under a taken name is an error."""

    def __init__(self) -> None:
        self._entries: dict[tuple[str, str], object] = {}

    def register(self, category: str, name: str, entry: object) -> object:
        if self._entries.setdefault((category, name), entry) is not entry:
            raise ValueError(f"{category}/{name} is taken")
        return entry

    def get(self, category: str, name: str) -> object:
        if (category, name) not in self._entries:
            raise KeyError(f"{category}/{name}")
        return self._entries[category, name]

    def build(self, category: str, name: str, *args: object, **options: object) -> object:
        return self.get(category, name)(*args, **options)

    def names(self, category: str) -> list[str]:
        return sorted(n for c, n in self._entries if c == category)

    def has(self, category: str, name: str) -> bool:
        return (category, name) in self._entries


from sequora.plans import queries as _queries  # noqa: E402, F401  (fills the tables above)
from sequora.plans import io_queries as _io_queries  # noqa: E402, F401
