"""Where the ledger's queries and their oracle SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywright.plans.views import with_views
from tallywright.sources.ledger import Ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    """Registers a function of a Ledger under its name; sql is what DuckDB runs behind the views named."""

    def register(build: Callable[[Ledger], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: build(Ledger(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_views(sql, *views.split())
        return build

    return register
