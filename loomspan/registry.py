"""Every query of the engine with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query, with the SQL that must give the same rows where SQL can express it."""

    def add(query: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are called {name}")
        _queries[name] = query
        if oracle is not None:
            _oracles[name] = oracle
        return query

    return add


def queries() -> dict[str, Query]:
    from loomspan import plans  # noqa: F401  (its modules register their queries)

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_oracles)
