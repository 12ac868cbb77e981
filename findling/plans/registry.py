"""Where queries are registered: a function of the views by its name, and SQL over the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.plans.standins import views, with_views

NOW = "2001-06-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def query(sql: str | None = None):
    """Registers a function of the views by its name; sql is over the same views."""

    def register(f: Callable[[dict], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(views(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_views(" ".join(sql.split()))
        return f

    return register
