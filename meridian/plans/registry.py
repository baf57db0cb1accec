"""All queries of the core engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with its SQL twin if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    """Imports the modules that register queries."""
    for module in ("relational", "analytics", "composite", "resolution", "surface"):
        importlib.import_module(f"meridian.plans.{module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["fusion_flagship"](spark, sf_dir)
