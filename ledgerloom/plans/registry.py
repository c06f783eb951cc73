"""All named queries of the core, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import shared_dir, ship

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("records", "case_plans", "series_plans", "pattern_plans", "network_plans", "text_plans", "report_plans")


def wrapped(query: Query) -> Query:
    """The query, with the package sent to the executors and the shared folder read from the session first."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        shared_dir(spark)
        return query(spark, folder)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def modules() -> list:
    return [importlib.import_module(f"ledgerloom.plans.{m}") for m in MODULES]


def queries() -> dict[str, Query]:
    return {name: wrapped(f) for m in modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in modules() for name, text in m.SQL.items()}
