"""Distributed ranks, totals and quantiles against pandas, with ties and hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayspan.functions import ordered as od


@pytest.fixture(scope="module")
def hot():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(400, 5.0), rng.integers(0, 40, 600).astype(float), rng.normal(10, 4, 200)])
    return pd.DataFrame({"id": np.arange(len(x)), "g": rng.choice(["a", "b", "c"], len(x), p=[0.8, 0.15, 0.05]), "x": x})


def test_number_rows_is_a_total_order(spark, hot):
    df = spark.createDataFrame(hot)
    for order, uniform in ((["x", "id"], None), (["id"], (0.0, 1200.0))):
        got = od.number_rows(df, order, "at", uniform).toPandas()
        want = hot.sort_values(order).reset_index(drop=True)
        assert (got.sort_values("at")["id"].to_numpy() == want["id"].to_numpy()).all()
        assert got["at"].tolist() and set(got["at_of"]) == {len(hot)}
        assert sorted(got["at"]) == list(range(1, len(hot) + 1))


def test_a_thousand_slices(spark, hot):
    df = spark.createDataFrame(hot)
    got = od.number_rows(df, ["x", "id"], "at", slices=1000).toPandas().sort_values("at")
    want = hot.sort_values(["x", "id"])
    assert got["at"].tolist() == list(range(1, len(hot) + 1)) and got["id"].tolist() == want["id"].tolist()
    counts = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    cum = od.running_totals(counts, ["g"], "x", ["n"], slices=1000).toPandas().sort_values(["g", "x"])
    assert (cum["cum_n"] == cum.groupby("g")["n"].cumsum()).all()


def test_a_hot_first_value_is_cut_by_the_second_column(spark, hot):
    """A third of the rows share the first value; no slice holds more than a few of them."""
    df = spark.createDataFrame(hot).repartitionByRange(40, "x", "id").withColumn("s", F.spark_partition_id())
    assert df.filter("x = 5").groupBy("s").count().agg(F.max("count")).first()[0] < 150


def test_average_ranks(spark, hot):
    df = spark.createDataFrame(hot)
    got = od.average_ranks(df, "x", ["g"]).toPandas()
    hot = hot.assign(r=hot.groupby("g")["x"].rank(method="average"))
    want = hot.groupby(["g", "x"])["r"].first().reset_index()
    both = got.merge(want, on=["g", "x"])
    assert len(both) == len(want) and np.allclose(both["rank"], both["r"])


def test_quantiles(spark, hot):
    df = spark.createDataFrame(hot)
    probs = {"q1": 0.25, "m": 0.5, "q9": 0.9}
    got = od.group_quantiles(df, ["g"], "x", probs).toPandas().set_index("g")
    for name, p in probs.items():
        want = hot.groupby("g")["x"].quantile(p)
        assert np.allclose(got[name].sort_index(), want.sort_index())


def test_running_totals_without_groups(spark, hot):
    rows = spark.createDataFrame(hot)
    counts = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = od.running_totals(counts, [], "x", ["n"]).toPandas().sort_values("x")
    assert (got["cum_n"].to_numpy() == got["n"].cumsum().to_numpy()).all()
    assert set(got["tot_n"]) == {len(hot)}


def test_empty_and_single_rows(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert od.group_quantiles(none, ["g"], "x", {"m": 0.5}).count() == 0
    one = spark.createDataFrame([("a", 3.0), ("a", None)], "g string, x double")
    assert od.group_quantiles(one, ["g"], "x", {"m": 0.5}).first()["m"] == 3.0
