"""Registry of the named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its check if SQL can say it."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def with_views(select: str, **views: str) -> str:
    """A SELECT with its source views as common table expressions."""
    ctes = ", ".join(f"{name} AS ({sql})" for name, sql in views.items())
    return f"WITH {ctes} {select}"


def r6(column: str):
    """A double rounded so that two engines agree on it."""
    return F.round(F.col(column).cast("double"), 6).alias(column)
