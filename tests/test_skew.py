"""One person-day with a third of all rows: the sliced steps equal pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayspan.operators import timeline as tl


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(11)
    n = 3000
    person = np.where(rng.random(n) < 0.35, 1, rng.integers(2, 40, n))
    day = np.where(person == 1, 0, rng.integers(0, 6, n))
    second = rng.integers(0, 86400, n)
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(days=int(d), seconds=int(s)) for d, s in zip(day, second)]
    a = np.where(rng.random(n) < 0.6, np.nan, rng.normal(5, 2, n))
    b = np.where(rng.random(n) < 0.95, np.nan, rng.normal(5, 2, n))
    return pd.DataFrame({"num_id": person, "ts": ts, "ord": np.arange(n), "a": a, "b": b, "c": rng.choice(["x", "y", None], n)})


def _spark(spark, raw):
    df = spark.createDataFrame(raw.astype({"c": object}), "num_id long, ts timestamp_ntz, ord long, a double, b double, c string")
    return df.select("num_id", "ts", "ord", F.nanvl("a", F.lit(None).cast("double")).alias("a"), F.nanvl("b", F.lit(None).cast("double")).alias("b"), "c")


def test_combine_same_day(spark, raw):
    got = tl.combine_same_day(_spark(spark, raw), "num_id", "ts", ["ts", "ord"], ["a", "b"], ["c"]).toPandas()
    want = []
    for (p, d), g in raw.assign(d=raw.ts.dt.date).groupby(["num_id", "d"]):
        g = g.sort_values(["ts", "ord"])
        f = g[["a", "b", "c"]].ffill().bfill()
        want.append((p, d, f.a.mean(), f.b.mean(), f.c.iloc[-1]))
    want = pd.DataFrame(want, columns=["num_id", "dt", "wa", "wb", "wc"])
    both = got.merge(want, on=["num_id", "dt"])
    assert len(both) == len(want) == len(got)
    assert np.allclose(both.a.astype(float), both.wa, equal_nan=True)
    assert np.allclose(both.b.astype(float), both.wb, equal_nan=True)
    assert (both.c.fillna("-") == both.wc.fillna("-")).all()


def test_sliced_fill_equals_plain_fill(spark, raw):
    df = _spark(spark, raw).withColumn("d", F.to_date("ts"))
    plain = tl.fill_within(df, ["num_id", "d"], ["ts", "ord"], ["a", "b"])
    for slices in (F.hour("ts"), tl.minute_slice(df, "ts")):
        sliced = tl.fill_within(df, ["num_id", "d"], ["ts", "ord"], ["a", "b"], slice_by=slices)
        assert sorted(plain.columns) == sorted(sliced.columns)
        assert plain.exceptAll(sliced.select(*plain.columns)).count() == 0
