"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
OPERATORS = ("lines", "quality", "mixing", "decontaminate", "chat", "pii", "urls", "jaccard", "pages", "tokens", "spelling", "phrases", "embedding")


def query(name: str, sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows where SQL can."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def load() -> None:
    for name in OPERATORS:
        importlib.import_module(f"dayspan.llm.ops.{name}")


def queries() -> dict[str, Query]:
    load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    load()
    return dict(ORACLES)
