import numpy as np
import pytest
from pyspark.sql import functions as F

from dayspan.operators import impute

COLS = ["a", "b", "c"]
SMALL = {"rounds": 3, "trees": 20, "depth": 5}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for p in range(6):
        for i in range(40 if p else 10):
            a = rng.normal()
            x = [a, 2 * a + rng.normal() * 0.05, -a + rng.normal() * 0.05]
            rows.append((p * 1000 + i, p, *[None if rng.random() < 0.15 else float(v) for v in x]))
    return spark.createDataFrame(rows, "cell long, num_id long, a double, b double, c double")


def _known_cells_kept(before, after):
    joined = before.alias("x").join(after.alias("y"), "cell")
    for c in COLS:
        assert joined.filter(f"x.{c} is not null and not (x.{c} <=> y.{c})").count() == 0


def test_hidden_cells_are_exact_in_number_and_known(table):
    masked, truth = impute.simulate_missing(table, "cell", COLS)
    n = int(table.count() * 3 * 0.1)
    assert truth.count() == truth.select("cell", "column").distinct().count() == n
    gone = sum(table.filter(F.col(c).isNotNull()).count() - masked.filter(F.col(c).isNotNull()).count() for c in COLS)
    assert gone == n
    again = impute.simulate_missing(table.repartition(7), "cell", COLS)[1]
    assert again.exceptAll(truth).count() == 0
    other = impute.simulate_missing(table, "cell", COLS, seed=7)[1]
    assert other.exceptAll(truth).count() > 0


def test_whole_table(table):
    out, ledger = impute.impute_table(table, "cell", COLS, 0.6, 0.8, **SMALL)
    verdict = ledger.first()
    assert verdict["accepted"] == 1 and verdict["r2"] > 0.8
    assert out.filter("a is null or b is null or c is null").count() == 0
    assert out.count() == table.count()
    _known_cells_kept(table, out)


def test_gates_keep_the_table(table):
    out, ledger = impute.impute_table(table, "cell", COLS, 0.99, **SMALL)
    assert ledger.first()["accepted"] == 0 and out.exceptAll(table).count() == 0


def test_by_person(table):
    out, ledger = impute.impute_by_person(table, "cell", COLS, **SMALL)
    rows = {r["num_id"]: r for r in ledger.collect()}
    assert rows[0]["eligible"] == 0 and rows[0]["accepted"] == 0  # ten rows only
    taken = [p for p, r in rows.items() if r["accepted"]]
    assert taken and all(rows[p]["r2"] > 0.8 for p in taken)
    gaps = out.filter("a is null or b is null or c is null").select("num_id").distinct()
    assert not {r[0] for r in gaps.collect()} & set(taken)
    _known_cells_kept(table, out)


def test_by_column(table):
    out, ledger = impute.impute_by_column(table, "cell", ["a", "b"], **SMALL)
    assert {r["column"] for r in ledger.collect()} == {"a", "b"}
    _known_cells_kept(table, out)


def test_error_is_null_where_a_guess_is_missing(spark):
    cells = spark.createDataFrame([("a", 1.0, 1.5), ("a", 2.0, None), ("b", 1.0, 1.0), ("b", 3.0, 2.0)], "column string, value double, guess double")
    got = {r["column"]: r for r in impute.imputation_error(cells, ["column"]).collect()}
    assert got["a"]["r2"] is None and got["a"]["p_value"] is None
    assert abs(got["b"]["rmse_scaled"] - np.sqrt(0.5) / 2) < 1e-12 and abs(got["b"]["r2"] - 0.5) < 1e-12
    bad = spark.createDataFrame([(1.0, 9.0), (2.0, -9.0)], "value double, guess double")
    base = impute.imputation_error(bad, fall_back=True).first()
    assert base["used_mean"] == 1 and base["r2"] == 0.0


def test_accept_rules(spark):
    df = spark.createDataFrame([(0.9, 0.5), (0.1, 0.01), (None, None)], "r2 double, p_value double")
    assert [r[0] for r in df.select(impute.accepted(0.8)).collect()] == [True, False, False]
    assert [r[0] for r in df.select(impute.accepted(0.8, "r2_or_ks")).collect()] == [True, True, False]
