"""Queries over the test tables, each with SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is one."""

    def register(query: Query) -> Query:
        key = name or query.__name__
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return register


def load_all() -> None:
    from . import (  # noqa: F401
        cell_checks,
        compare_checks,
        index_checks,
        profile_checks,
        ref_checks,
        search_checks,
        summary_checks,
        token_checks,
    )
