"""Registered queries: each runs an operator over the given tables, most with a SQL oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from covenantry.fixtures import Fixtures, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FAMILIES = ("sources", "text", "rows", "joins", "rollups", "latest", "matching", "mutations",
            "notices", "evaluation", "flows")


def query(name: str, oracle: str | None = None):
    """Register ``build(fixtures)`` under a name, with the SQL that must give the same rows."""
    def add(build: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Fixtures(spark, folder))
        if oracle is not None:
            ORACLES[name] = check_sql(oracle)
        return build

    return add


def load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"covenantry.catalog.{family}")
