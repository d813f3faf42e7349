"""Registration of named queries with their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
# Averages of cent values often end exactly halfway between two 6-digit numbers, where the
# last bit of a float decides the rounding. Both engines add this before they round.
NUDGE = 1e-9

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is checked by tests on small fixtures instead."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = re.sub(r"\bround\(", f"round({NUDGE} + ", sql)
        return fn

    return keep


def r6(col) -> Column:
    """Six-digit rounding of a query result, matched by ``round(x, 6)`` in the SQL."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col + F.lit(NUDGE), 6)


def hash_sql(expr: str, seed: int = 42) -> str:
    """``stable_hash`` as SQL."""
    h = f"((({expr}) % 2147483648 * 2654435761 + {seed * 40503}) % 4294967296)"
    h = f"(xor({h}, {h} >> 15) * 2146121005 % 4294967296)"
    return f"xor({h}, {h} >> 13)"
