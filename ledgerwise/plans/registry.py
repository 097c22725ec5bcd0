"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerwise.plans.views import comparable, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` may use the named views."""

    def register(build: Query) -> Query:
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: comparable(build(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql, *views) if views else sql
        return build

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from ledgerwise.plans import (  # noqa: F401
        calendar_queries,
        file_queries,
        function_queries,
        manifest_queries,
        quality_queries,
        report_queries,
        write_queries,
    )
