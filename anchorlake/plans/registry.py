"""Registry of the queries that exercise every operator on the given tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from anchorlake.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one scale directory, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register a query, with the SQL that must give the same rows where there is one."""
    def register(build: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(tune(spark), folder))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def columns(**expressions: str) -> list[str]:
    """Select list for ``selectExpr`` from name -> SQL text."""
    return [f"{sql} AS {name}" for name, sql in expressions.items()]
