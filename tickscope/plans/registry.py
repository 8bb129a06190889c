"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickscope.plans.fixtures import render, view
from tickscope.session import prepare_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """Attribute access to the adapter views: ``v.items`` is ``fx_items``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"fx_{name}")

    def table(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"#{name}")


def query(name: str, sql: str | None = None):
    """Register ``build(v)`` under ``name``; ``sql`` is its DuckDB twin."""

    def add(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return build(Views(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = render(sql, "duckdb")
        return build

    return add
