import math

import numpy as np
from pyspark.sql import functions as F

from dayspan.functions import tails
from dayspan.operators import clean, encode, transform


def _grubbs_by_hand(x, alpha):
    x = list(x)
    while len(x) >= 3:
        a = np.array(x)
        sd = a.std(ddof=1)
        at = int(np.argmax(np.abs(a - a.mean())))
        if not abs(a[at] - a.mean()) > tails.grubbs_critical(len(x), alpha) * sd:
            break
        x.pop(at)
    return x


def test_grubbs_matches_the_one_by_one_test(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.exponential(1.0, 500), [30.0, 30.0, 31.5, -9.0], np.full(50, 0.7)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None)], "id long, x double")
    kept = [r["x"] for r in transform.grubbs_outliers(df, ["x"]).filter("x is not null").collect()]
    assert sorted(kept) == sorted(_grubbs_by_hand(x, 0.05))
    small = transform.grubbs_bounds(df, ["x"], batch=2)
    assert small == transform.grubbs_bounds(df, ["x"])


def test_grubbs_leaves_constant_and_tiny_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, None), (1.0, 5.0)], "a double, b double")
    assert transform.grubbs_outliers(df, ["a", "b"]).filter("a is null").count() == 0


def test_boxcox_exponent(spark):
    rng = np.random.default_rng(2)
    x = rng.lognormal(1.0, 0.5, 2000) ** 1.7 + 0.5

    def loss(lam):
        z = np.log(x) - np.log(x).mean()
        return np.var(z if abs(lam) < 1e-12 else np.expm1(lam * z) / lam)

    grid = np.linspace(-3, 3, 6001)
    best = grid[np.argmin([loss(v) for v in grid])]
    df = spark.createDataFrame([(float(v), -1.0) for v in x], "x double, bad double")
    lams = transform.boxcox_lambdas(df, ["x", "bad"])
    assert abs(lams["x"] - best) < 1e-3 and lams["bad"] is None
    assert loss(lams["x"]) <= loss(best) + 1e-12
    out, _ = transform.boxcox(df, ["x", "bad"])
    assert out.filter("bad != -1").count() == 0


def test_scaling_edges(spark):
    df = spark.createDataFrame([(0.0, 2.0), (1.0, 2.0), (3.0, 2.0), (None, 2.0)], "x double, c double")
    z = transform.zscore(df, ["x", "c"]).collect()
    assert {r["c"] for r in z} == {0.0} and z[3]["x"] is None
    m = [r["x"] for r in transform.minmax_nonzero(df, ["x"]).collect()]
    assert m == [None, 0.0, 1.0, None]


def test_residuals_are_orthogonal_to_covariates(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=300), rng.normal(size=300)
    y = 3 + 2 * a - b + rng.normal(size=300)
    df = spark.createDataFrame([(float(i), float(j), float(k)) for i, j, k in zip(a, b, y)], "a double, b double, y double")
    out = transform.residualise(df, ["y"], ["a", "b"]).agg(F.avg("y"), F.corr("y", "a"), F.corr("y", "b")).first()
    assert all(abs(v) < 1e-9 for v in out)


def test_tails_known_values():
    assert abs(tails.t_two_sided(2.228138852, 10) - 0.05) < 1e-8
    assert abs(tails.chi2_tail(5.991464547, 2) - 0.05) < 1e-8
    assert abs(tails.chi2_tail(18.30703805, 10) - 0.05) < 1e-8
    assert abs(tails.ks_tail(1.3580986 / math.sqrt(50), 100, 100) - 0.05) < 1e-4
    assert abs(tails.t_quantile(0.025, 10) - 2.228138852) < 1e-7
    assert abs(tails.grubbs_critical(10, 0.05) - 2.290) < 1e-3


def test_encode_missing_is_last_and_decodes(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, c string")
    coded, key = encode.label_encode(df, ["c"])
    assert {r["id"]: r["c"] for r in coded.collect()} == {1: 1, 2: 2, 3: 0, 4: 1}
    assert sorted(encode.label_decode(coded, ["c"], key).collect()) == sorted(df.collect())


def test_many_distinct_labels_are_ranked_in_slices(spark, monkeypatch):
    names = [f"Customer#{i * 7919 % 2500:06d}" for i in range(600)] + ["Customer#", "Customer#é", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names * 2)], "id int, c string")
    small = {r["label"]: r["encoding"] for r in encode.encoder_key(df, ["c"]).collect()}
    monkeypatch.setattr(encode, "CATEGORY_BOUND", 5)
    large = {r["label"]: r["encoding"] for r in encode.encoder_key(df, ["c"]).collect()}
    known = sorted({n for n in names if n is not None}, key=lambda n: n.encode())
    assert large == small == {**{n: i for i, n in enumerate(known)}, None: len(known)}


def test_numbers_are_coded_in_number_order(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i == 3 else (i * 37) % 101) for i in range(101)], "id int, c int")
    want = {str(v): n for n, v in enumerate(sorted({(i * 37) % 101 for i in range(101)} - {(3 * 37) % 101}))}
    for bound in (encode.CATEGORY_BOUND, 5):
        monkeypatch.setattr(encode, "CATEGORY_BOUND", bound)
        got = {r["label"]: r["encoding"] for r in encode.encoder_key(df, ["c"]).collect()}
        assert got == {**want, None: len(want)}
        assert encode.label_encode(df, ["c"])[0].filter("id = 3").first()["c"] == len(want)


def test_log_is_refused_for_negative_columns(spark):
    df = spark.createDataFrame([(1.0, -1.0), (0.0, 2.0)], "a double, b double")
    out, refused = clean.log1p_safe(df, ["a", "b"])
    assert refused == ["b"] and [r["a"] for r in out.collect()] == [math.log(2), 0.0]


def test_rates_with_zero_and_missing_hours(spark):
    df = spark.createDataFrame([(4.0, 2.0, True), (4.0, 0.0, True), (4.0, None, False)], "x double, h double, b boolean")
    out = clean.per_hour(df, ["x", "b"], "h")
    assert [r["x_hr"] for r in out.collect()] == [2.0, None, None] and "b_hr" not in out.columns
