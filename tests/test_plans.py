"""Shape of the physical plans: shuffles, pushdown, no Python where it is not needed."""

import re

from pyspark.sql import functions as F

from dayspan.operators import timeline as tl
from dayspan.plans import inputs as inp
from dayspan.plans import registry
from dayspan.plans.preparing import keyed_panel
from dayspan.operators import transform


def plan(df, mode="simple"):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_three_shuffles(spark, sf):
    text = plan(registry.flagship(spark, sf))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 3
    assert "Join" not in text and "Python" not in text and "rangepartitioning" not in text


def test_scan_reads_only_needed_columns(spark, sf):
    text = plan(inp.panel_day(spark, sf))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema


def test_filters_reach_the_scan(spark, sf):
    q = inp.table(spark, sf, "orders").filter(F.col("o_totalprice") > 1000).select("o_orderkey")
    text = plan(q)
    assert "GreaterThan(o_totalprice,1000.0)" in text and "o_orderdate" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_wide_features_need_one_shuffle_over_a_keyed_panel(spark, sf):
    base = keyed_panel(spark, sf).withColumns({"week": F.lit(0), "day": F.lit(0)})
    extra = plan(tl.wide_features(base, ["view", "click"])).count("Exchange hashpartitioning") - plan(base).count("Exchange hashpartitioning")
    assert extra == 1


def test_transforms_are_projections(spark, sf):
    text = plan(transform.zscore(inp.line_numbers(spark, sf), ["l_quantity"]))
    assert "Exchange" not in text
