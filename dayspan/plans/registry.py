"""All registered queries and the flagship plan."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from dayspan.operators import timeline as tl
from dayspan.plans import inputs as inp
from dayspan.plans.base import ORACLES, QUERIES, Query

SECTIONS = (
    "tables", "cleaning", "merging", "grouping", "time", "preparing",
    "structure", "grouping_people", "testing", "splitting", "modelling",
)


def _load() -> None:
    for name in SECTIONS:
        importlib.import_module(f"dayspan.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events to one wide row per person."""
    days = inp.panel_full(spark, sf)
    known = tl.interpolate_weekly(days, inp.FEATURES, 40.0)
    return tl.wide_features(known, [f"{c}_int" for c in inp.FEATURES])
