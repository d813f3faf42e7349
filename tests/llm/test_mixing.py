import math

import pytest
from pyspark.sql import functions as F

from dayspan.llm import mixing


def fill(sizes, cycle, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] >= cap * sizes[s]}
        if not over:
            return target | {s: rate * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_order_and_totals(spark):
    rows = [(i, ["a", "b", None, "é", "z"][i % 5 if i % 3 else 0], (i * 37) % 50, 1.0 + i % 3) for i in range(600)]
    rows += [(7, "b", 3, None), (None, "zz", 5, 0.0), (701, "zero", 0, 1.0), (702, "zero", None, -1.0)]
    df = spark.createDataFrame(rows, "id long, source string, size long, weight double").repartition(4)
    out = mixing.mix(df, [3.0, 1.0, 2.0], 1.5, 2.0, 5, slices=16).collect()
    again = mixing.mix(df.repartition(7), [3.0, 1.0, 2.0], 1.5, 2.0, 5, slices=512).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))  # the slices do not matter
    sizes = {}
    for r in rows:
        sizes[r[1]] = sizes.get(r[1], 0) + (r[2] or 0)
    want = fill(sizes, [3.0, 1.0, 2.0], 1.5, 2.0)
    assert len(out) == len(rows)
    for s in sizes:
        part = [r for r in out if r.source == s]
        assert {r.source_size for r in part} == {sizes[s]}
        assert part[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in part) - want[s]) <= 25  # half of the largest row
        assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in part)


def test_weight_favours_and_keys_are_exponential(spark):
    df = spark.range(4000).select("id", F.lit("s").alias("source"), F.lit(10).alias("size"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    out = mixing.mix(df, [1.0], 0.25, 2.0, 3).filter("copies = 1").collect()
    heavy = sum(r.id % 2 == 0 for r in out)
    assert len(out) == 1000
    # rows are taken until 1 - (exp(-t) + exp(-4t)) / 2 = 1/4
    t = next(x / 1e4 for x in range(1, 10000) if 1 - (math.exp(-x / 1e4) + math.exp(-4 * x / 1e4)) / 2 >= 0.25)
    assert heavy == pytest.approx(2000 * (1 - math.exp(-4 * t)), abs=60)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, source string, size long, weight double")
    assert mixing.mix(df, [1.0], 1.5, 2.0, 1).count() == 0


def test_rows_without_a_weight_share_no_slice(spark):
    """Whatever the weights are, rows of one weight spread over many slices of the key."""
    rows = spark.range(20_000).select("id", F.lit("s").alias("source"), F.lit(1).alias("size"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 0.0).otherwise(2.0).alias("weight"))
    key = -F.log(mixing.uniform(F.col("id"), 5)) / F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(mixing.LEAST_WEIGHT))
    most = rows.groupBy(F.floor(F.log2(key) * mixing.PER_OCTAVE)).count().agg(F.max("count")).first()[0]
    assert most < 20_000 * 4 / mixing.PER_OCTAVE
    taken = mixing.mix(rows, [1.0], 0.5, 2.0, 5).groupBy(F.col("id") % 3 == 2).agg(F.sum("taken").alias("n")).collect()
    got = {r[0]: r.n for r in taken}
    assert sum(got.values()) == 10_000 and got[True] == rows.filter("weight = 2.0").count()  # the weighted rows come first
