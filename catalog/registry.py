"""Collecting the queries by name."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.views import Views
from densekit.session import tune

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query, with the SQL it must agree with if there is one."""

    def add(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = check
        return build

    return add


def runner(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Views(tune(spark), sf_dir))
