"""Queries by name: the Spark side, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readforge.functions.fixtures import fixture, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, reads: tuple[str, ...] = ()) -> Callable:
    """Register a query. Its function gets the fixtures named in ``reads`` after (spark, sf_dir)."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir, *[fixture(spark, sf_dir, r) for r in reads])
        if sql:
            ORACLES[name] = with_fixtures(sql, *reads) if reads else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
