"""Registry of named queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
_runs: dict[str, Run] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; ``sql`` gives the same rows in DuckDB, where SQL can express them."""

    def add(run: Run) -> Run:
        if name in _runs:
            raise ValueError(f"query {name} is registered twice")
        _runs[name] = run
        if sql:
            _sql[name] = sql
        return run

    return add


def registered() -> tuple[dict[str, Run], dict[str, str]]:
    from tessella.plans import composed, documents, fulltext, operations, search, understanding  # noqa: F401  registers their queries

    return dict(_runs), dict(_sql)
