"""Registered queries: each applies one operator to the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.plans.fixtures import Fixtures, with_views

#: The fixed clock of all registered queries.
NOW = "2024-01-15 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def query(name: str, sql: str | None = None):
    """Register a query over fixtures; ``sql`` is the same in DuckDB's dialect."""

    def add(make: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, folder: make(Fixtures(spark, folder))
        if sql:
            ORACLES[name] = with_views(sql.replace("$NOW", f"timestamp '{NOW}'"))
        return make

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns rounded to six places."""
    return df.withColumns({c: F.round(c, 6) for c in columns})
