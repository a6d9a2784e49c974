"""Named queries over the tables, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.session import ship_package
from larkspur.sources.tables import Tables

Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def plan(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a query under its function's name."""

    def add(function: Plan) -> Plan:
        key = name or function.__name__
        if key in PLANS:
            raise ValueError(f"{key} is defined twice")
        PLANS[key] = function
        if sql is not None:
            SQL[key] = sql
        return function

    return add


def runnable(function: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return function(Tables(spark, folder))

    return run


def load() -> None:
    """Imports every module of queries."""
    from larkspur.plans import aggregates, benchmark, functions, joins, json_queries, scans, tables, windows  # noqa: F401
