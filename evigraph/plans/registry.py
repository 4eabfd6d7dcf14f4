"""Registry of runnable queries with their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigraph.plans.sql_views import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Prefix a statement with the named view definitions; a leading comma continues the WITH list."""
    body = sql.strip()
    if not views:
        return "WITH" + body[1:] if body.startswith(",") else body
    definitions = ",\n".join(f"{name} AS ({SQL_VIEWS[name].strip()})" for name in views)
    return f"WITH {definitions}{'' if body.startswith(',') else ' '}\n{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return function

    return register
