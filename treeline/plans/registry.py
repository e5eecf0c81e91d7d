"""Every query of the library with its oracle, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; oracle: DuckDB SQL with the same rows, none where SQL can't express it."""

    def put(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return put


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is one SQL text over the driver's tables; oracle: where DuckDB's dialect differs."""
    from ..relations import with_views

    query(name, oracle or text)(lambda spark, sf_dir: with_views(spark, sf_dir, text))


def _load() -> None:
    from . import catalog  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
