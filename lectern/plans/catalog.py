"""All queries of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name; sql: the DuckDB SQL of the same rows."""

    def register(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


from lectern.plans import indexed, keyed, linking, ordering, placing, printed, referring, resolving, searching, shaping, sourcing, spelling, studying, wordwise  # noqa: E402, F401  they register their queries
