"""Small literal panels with known results for the three core steps."""

import datetime as dt

from pyspark.sql import functions as F

from dayspan.operators import timeline as tl


def day(text):
    return dt.datetime.fromisoformat(text)


def test_same_day_rows_are_filled_then_averaged(spark):
    rows = [
        (1, day("2020-01-01 08:00:00"), 0, 2, "0", 0),
        (1, day("2020-01-01 09:00:00"), 1, 0, "2", 0),
        (1, day("2020-01-08 08:00:00"), 2, 0, "2", 1),
        (1, day("2020-01-15 08:00:00"), 3, 0, "4", 2),
    ]
    df = spark.createDataFrame(rows, "num_id int, ts timestamp_ntz, ord int, valueA int, valueB string, week int")
    out = tl.combine_same_day(df, "num_id", "ts", ["ts", "ord"], ["valueA"], ["valueB"], week="week").orderBy("dt").collect()
    assert [r["valueA"] for r in out] == [1.0, 0.0, 0.0]
    assert [r["valueB"] for r in out] == ["2", "2", "4"]
    assert [r["week"] for r in out] == [0, 1, 2]
    first = tl.combine_same_day(df, "num_id", "ts", ["ts", "ord"], ["valueA"], ["valueB"], text_rule="first").orderBy("dt").collect()
    assert [r["valueB"] for r in first] == ["0", "2", "4"]


def test_a_gap_inside_a_day_counts_at_the_last_known_value(spark):
    rows = [(1, day(f"2020-01-01 0{i}:00:00"), v) for i, v in enumerate([2.0, None, 4.0])]
    df = spark.createDataFrame(rows, "num_id int, ts timestamp_ntz, x double")
    out = tl.combine_same_day(df, "num_id", "ts", ["ts"], ["x"]).first()
    assert abs(out["x"] - 8 / 3) < 1e-12


def test_densify_gives_every_day_between_first_and_last(spark):
    rows = [
        (1, "2020-01-01", 2), (1, "2020-01-03", 0), (1, "2020-01-06", 0),
        (2, "2020-01-01", 1), (2, "2020-01-02", 2),
        (3, "2020-01-06", 1), (3, "2020-01-09", 2), (3, "2020-01-09", 3),
    ]
    df = spark.createDataFrame([(p, day(d + " 00:00:00"), i, v) for i, (p, d, v) in enumerate(rows)], "num_id int, ts timestamp_ntz, ord int, valueA int")
    days = tl.combine_same_day(df, "num_id", "ts", ["ts", "ord"], ["valueA"])
    assert [r["valueA"] for r in days.orderBy("num_id", "dt").collect()] == [2, 0, 0, 1, 2, 1, 2.5]
    dense = tl.day_number(tl.densify_days(days))
    sizes = {r["num_id"]: r["n"] for r in dense.groupBy("num_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {1: 6, 2: 2, 3: 4}
    for p in sizes:
        part = dense.filter(F.col("num_id") == p).orderBy("dt").collect()
        assert [r["day"] for r in part] == list(range(sizes[p]))
        assert all((b["dt"] - a["dt"]).days == 1 for a, b in zip(part, part[1:]))
    assert dense.filter("valueA is not null").count() == 7


def test_weeks_count_from_the_first_date_of_the_person(spark):
    rows = [(1, "2020-01-01"), (1, "2020-01-02"), (1, "2020-01-08"), (1, "2020-01-15"),
            (2, "2020-01-08"), (2, "2020-01-01"), (2, "2020-01-15"), (2, "2020-01-09"), (3, "2020-01-01")]
    df = spark.createDataFrame(rows, "num_id int, d string").select("num_id", F.to_date("d").alias("dt"), F.lit(0).alias("week"))
    out = tl.assign_week(df).orderBy("num_id", "dt").collect()
    assert [r["week"] for r in out] == [0, 0, 1, 2, 0, 1, 1, 2, 0]


def test_interpolation_gates_and_edges(spark):
    base = dt.date(2020, 1, 1)
    series = {1: [None, 2.0, None, 6.0, None, 8.0, None], 2: [1.0, None, None, None, None, None, None], 3: [1.0] * 7}
    rows = [(p, base + dt.timedelta(days=i), 0, v) for p, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "num_id int, dt date, week int, x double")
    out = tl.interpolate_weekly(df, ["x"], 40.0)
    got = {p: [r["x_int"] for r in out.filter(F.col("num_id") == p).orderBy("dt").collect()] for p in series}
    assert got[1] == [None, 2.0, 4.0, 6.0, 7.0, 8.0, 8.0]
    assert got[2] == series[2]
    assert got[3] == series[3]
    yields = tl.interpolation_yield(out, ["x"]).first()
    assert (yields["weeks"], yields["improved"]) == (3, 1)


def test_slopes_need_two_rows_and_no_gap(spark):
    rows = [(1, 0, 1.0), (1, 1, 3.0), (2, 0, 1.0), (3, 0, 1.0), (3, 1, None), (3, 2, 5.0)]
    df = spark.createDataFrame(rows, "num_id int, day int, x double")
    got = {r["num_id"]: r["x_slope"] for r in tl.person_slope(df, ["x"]).collect()}
    assert got == {1: 2.0, 2: None, 3: None}
