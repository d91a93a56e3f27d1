"""Queries over the driver tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sensorframe.queries import modelling, relational, reports
from sensorframe.session import tune


def _tuned(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(tune(spark), sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {**relational.QUERIES, **modelling.QUERIES, **reports.QUERIES}
    return {name: _tuned(query) for name, query in found.items()}


def all_sql() -> dict[str, str]:
    return {**relational.SQL, **modelling.SQL, **reports.SQL}
