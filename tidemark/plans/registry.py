"""Register a query under its name, with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: tuple[str, ...] = ()):
    """The decorated function's name is the query's. ``ctes`` name the view definitions that ``sql`` uses."""
    from .views import CTES

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            head = "WITH RECURSIVE " if "RECURSIVE" in sql[:12] else "WITH "
            body = sql.removeprefix("RECURSIVE ")
            needed = [CTES[c] for c in ctes]
            if body.lstrip().startswith("+"):  # more definitions of its own
                body = body.lstrip()[1:]
                ORACLE_SQL[f.__name__] = head + ", ".join([*needed, body])
            elif needed:
                ORACLE_SQL[f.__name__] = head + ", ".join(needed) + " " + body
            else:
                ORACLE_SQL[f.__name__] = body
        return f

    return register
