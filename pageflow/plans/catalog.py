"""Registry of runnable queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pageflow.fixtures import Tables, with_fixtures
from pageflow.session import bound_tasks, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, recursive: bool = False):
    """Register ``fn(tables)`` under ``name``; ``oracle`` may refer to any fixture view."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(bound_tasks(tune(spark)), sf_dir))
        if oracle:
            ORACLES[name] = with_fixtures(oracle, recursive=recursive)
        return fn

    return add
