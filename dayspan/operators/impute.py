"""Hiding known cells, forest imputation, scoring on the hidden cells, acceptance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.functions.columns import stable_hash
from dayspan.functions.ordered import number_rows
from dayspan.operators.clean import replace_columns
from dayspan.operators.forests import fit_forests, forest_prediction
from dayspan.operators.inference import ks_two_sample
from dayspan.session import cut_lineage

HASH_RANGE = (0.0, 4294967296.0)
# Tables up to this size take MLlib's forests, whose few jobs cost less; in larger ones the trees of a column grow together.
SMALL_ROWS = 50_000


def _hide(df: DataFrame, key: str, hidden: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Blank the listed cells with one join on the row key."""
    gone = hidden.groupBy(key).agg(F.collect_set("column").alias("_gone"))
    joined = df.join(gone, key, "left")
    masked = replace_columns(
        joined, {c: F.when(~F.coalesce(F.array_contains("_gone", c), F.lit(False)), F.col(c)) for c in cols}
    )
    return masked.drop("_gone")


def simulate_missing(
    df: DataFrame, key: str, cols: Sequence[str], share: float = 0.1, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Hide ``floor(share * all cells)`` known cells, without repeats.

    Returns the masked frame and the truth table (key, column, value). Cells are
    taken in the order of a hash of (row, column), so a rerun hides the same ones. The table is
    evaluated once: it is counted, ranked and joined from a checkpoint.
    """
    df = cut_lineage(df)
    long = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("_at"), F.col(c).alias("value")) for i, c in enumerate(cols)
    ])
    cells = df.select(key, F.explode(long).alias("_c")).select(key, "_c.*").filter(F.col("value").isNotNull())
    keyed = cells.select(key, "column", "value", stable_hash(F.col(key) * len(cols) + F.col("_at"), seed).alias("_h"))
    take = int(df.count() * len(cols) * share)
    hidden = number_rows(keyed, ["_h", key, "column"], "_at", HASH_RANGE).filter(F.col("_at") <= take).select(key, "column", "value")
    return _hide(df, key, hidden, cols), hidden


def simulate_missing_col(
    df: DataFrame, key: str, col: str, share: float = 0.1, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Hide ``floor(share * rows)`` known values of one column; the table is evaluated once."""
    df = cut_lineage(df)
    known = df.select(key, F.col(col).alias("value")).filter(F.col("value").isNotNull())
    keyed = known.withColumn("_h", stable_hash(F.col(key), seed))
    take = int(df.count() * share)
    hidden = number_rows(keyed, ["_h", key], "_at", HASH_RANGE).filter(F.col("_at") <= take)
    hidden = hidden.select(key, F.lit(col).alias("column"), "value")
    return _hide(df, key, hidden, [col]), hidden


def compare_cells(truth: DataFrame, imputed: DataFrame, key: str, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Truth next to the imputed value of the same cell: (key, column, value, guess)."""
    long = imputed.unpivot([key, *keep], list(cols), "column", "guess")
    return truth.join(long, [key, "column"])


def imputation_error(cells: DataFrame, by: Sequence[str] = (), fall_back: bool = False) -> DataFrame:
    """RMSE over the mean truth, R2 and the KS p-value on hidden cells.

    If a truth or guess is missing the metrics are null. With ``fall_back`` the
    mean of the truth stands in for an imputation that is worse than it.
    """
    if not by:
        whole = imputation_error(cells.withColumn("_all", F.lit(1)), ["_all"], fall_back)
        return whole.drop("_all")
    by = list(by)
    gap = (F.col("value") - F.col("guess")) * (F.col("value") - F.col("guess"))
    lost = F.count_if(F.col("value").isNull() | F.col("guess").isNull())
    sums = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"),
        lost.alias("_lost"),
        F.avg("value").alias("_mean"),
        F.avg(gap).alias("_mse"),
        F.var_pop("value").alias("_var"),
    )
    ok = F.col("_lost") == 0
    r2 = 1 - F.try_divide("_mse", F.col("_var"))
    both = cells.select(*by, F.explode(F.array(
        F.struct(F.col("value").alias("x"), F.lit(True).alias("first")),
        F.struct(F.col("guess").alias("x"), F.lit(False).alias("first")),
    )).alias("s")).select(*by, "s.x", "s.first")
    ks = ks_two_sample(both, "x", F.col("first"), by).select(*by, "p_value")
    out = sums.join(ks, by).select(
        *by,
        "cells",
        F.when(ok, F.try_divide(F.sqrt("_mse"), F.col("_mean"))).alias("rmse_scaled"),
        F.when(ok, r2).alias("r2"),
        F.when(ok, F.col("p_value")).alias("p_value"),
    )
    if fall_back:
        out = out.withColumn("used_mean", (F.col("r2") < 0).cast("int")).withColumn("r2", F.when(F.col("r2") < 0, 0.0).otherwise(F.col("r2")))
    return out


def forest_impute(
    df: DataFrame,
    key: str,
    cols: Sequence[str],
    person: str | None = None,
    helpers: Sequence[str] = (),
    rounds: int = 3,
    trees: int = 50,
    depth: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Chained random-forest imputation; known cells are never changed.

    Gaps start at the column mean. Each round refits every column on the others
    (and on ``helpers``, which must be complete) from its known rows. With
    ``person`` the person's own column means join the predictors, so one pooled
    model replaces a model per person. Over ``SMALL_ROWS`` rows the trees of a column take one scan
    a level (``fit_forests``), with draws from a hash of the row key.
    """
    means = df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in cols]).first()
    n = means["_n"]
    cols = [c for c in cols if means[c] is not None]
    extra = list(helpers)
    state = df.select(
        key, *([person] if person else []), *helpers, *cols, *[F.col(c).isNull().alias(f"_gap_{c}") for c in cols]
    )
    if person:
        own = state.groupBy(person).agg(*[F.coalesce(F.avg(c), F.lit(means[c])).alias(f"_own_{c}") for c in cols])
        state = state.join(own, person)
        extra += [f"_own_{c}" for c in cols]
    state = cut_lineage(replace_columns(state, {c: F.coalesce(c, F.lit(means[c])) for c in cols}))
    for _ in range(rounds):
        for c in cols:
            inputs = [x for x in cols if x != c] + extra
            gap = F.col(f"_gap_{c}")
            if n > SMALL_ROWS:
                x = F.array(*[F.col(i).cast("double") for i in inputs])
                known = state.filter(~gap).select(x.alias("x"), F.col(c).cast("double").alias("y"), F.xxhash64(key).alias("h"), F.lit(0).alias("first"))
                model = fit_forests(known, 1, trees, depth, seed)
                guess = forest_prediction(state, model, x, F.when(gap, 0).otherwise(-1))
                state = replace_columns(state, {c: F.when(gap, guess).otherwise(F.col(c))})
                continue
            ready = VectorAssembler(inputCols=inputs, outputCol="_x").transform(state)
            forest = RandomForestRegressor(
                featuresCol="_x", labelCol=c, predictionCol="_guess", numTrees=trees, maxDepth=depth, seed=seed,
                featureSubsetStrategy="all",
            )
            guess = forest.fit(ready.filter(~gap)).transform(ready)
            state = guess.select(*[F.when(gap, F.col("_guess")).otherwise(F.col(c)).alias(c) if x == c else F.col(x) for x in state.columns])
        state = cut_lineage(state)
    filled = state.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = df.join(filled, key)
    return replace_columns(joined, {c: F.coalesce(c, f"_new_{c}") for c in cols}).drop(*[f"_new_{c}" for c in cols])


def accepted(r2_limit: float, rule: str = "r2") -> Column:
    """``r2``: R2 over the limit. ``r2_or_ks``: or a KS p-value under 0.05."""
    good = F.coalesce(F.col("r2") > r2_limit, F.lit(False))
    if rule == "r2":
        return good
    return good | F.coalesce(F.col("p_value") < 0.05, F.lit(False))


def impute_table(
    df: DataFrame, key: str, cols: Sequence[str], share: float = 0.6, r2_limit: float = 0.8, rule: str = "r2", **forest
) -> tuple[DataFrame, DataFrame]:
    """Impute the whole table if enough is known and the hidden cells come back well.

    Columns without gaps or without values are left out. Returns frame and ledger.
    """
    df = cut_lineage(df)  # read by the gates, the mask, every forest and the final fill
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols]).first()
    n = counts["_n"]
    some = [c for c in cols if 0 < counts[c] < n]
    known = sum(counts[c] for c in some) / (n * len(some)) if some and n else 0.0
    spark, schema = df.sparkSession, "share double, r2 double, p_value double, accepted int"
    if not some or known < share:
        return df, spark.createDataFrame([(known, None, None, 0)], schema)
    masked, truth = simulate_missing(df, key, some)
    imputed = forest_impute(masked, key, some, **forest)
    ledger = imputation_error(compare_cells(truth, imputed, key, some)).select(
        F.lit(known).alias("share"), "r2", "p_value", accepted(r2_limit, rule).cast("int").alias("accepted")
    )
    verdict = ledger.first()
    ledger = spark.createDataFrame([tuple(verdict)], schema)
    if not verdict["accepted"]:
        return df, ledger
    fill = imputed.select(key, *[F.col(c).alias(f"_new_{c}") for c in some])
    out = replace_columns(df.join(fill, key), {c: F.coalesce(c, f"_new_{c}") for c in some})
    return out.drop(*[f"_new_{c}" for c in some]), ledger


def impute_by_person(
    df: DataFrame,
    key: str,
    cols: Sequence[str],
    person: str = "num_id",
    min_rows: int = 20,
    share: float = 0.6,
    r2_limit: float = 0.8,
    rule: str = "r2",
    **forest,
) -> tuple[DataFrame, DataFrame]:
    """Impute the persons who pass the gates and whose own hidden cells come back well.

    One pooled model with the person's means as predictors is scored per person;
    the others keep their gaps. The ledger has one row per person.
    """
    df = cut_lineage(df)
    known = sum(F.count(c) for c in cols) / (F.count(F.lit(1)) * len(cols))
    gates = df.groupBy(person).agg(F.count(F.lit(1)).alias("rows"), known.alias("share"))
    gates = gates.withColumn("eligible", ((F.col("rows") >= min_rows) & (F.col("share") >= share)).cast("int"))
    pool = cut_lineage(df.join(gates.filter("eligible = 1").select(person), person, "left_semi"))
    masked, truth = simulate_missing(pool, key, cols)
    imputed = cut_lineage(forest_impute(masked, key, cols, person=person, **forest))
    errors = imputation_error(compare_cells(truth, imputed, key, cols, [person]), [person])
    ledger = gates.join(errors, person, "left").select(
        person, "rows", "share", "eligible", "cells", "rmse_scaled", "r2", "p_value",
        ((F.col("eligible") == 1) & accepted(r2_limit, rule)).cast("int").alias("accepted"),
    )
    ledger = cut_lineage(ledger)
    fill = imputed.join(ledger.filter("accepted = 1").select(person), person, "left_semi").select(
        key, *[F.col(c).alias(f"_new_{c}") for c in cols]
    )
    out = replace_columns(df.join(fill, key, "left"), {c: F.coalesce(c, f"_new_{c}") for c in cols})
    return out.drop(*[f"_new_{c}" for c in cols]), ledger


def impute_by_column(
    df: DataFrame, key: str, cols: Sequence[str], missing_share: float = 0.3, r2_limit: float = 0.8, rule: str = "r2", **forest
) -> tuple[DataFrame, DataFrame]:
    """Impute column by column, each judged on its own hidden values."""
    df = cut_lineage(df)
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols]).first()
    out, rows = df, []
    for c in cols:
        gap = 1 - counts[c] / counts["_n"]
        if counts[c] == 0 or gap == 0 or gap >= missing_share:
            rows.append((c, gap, None, None, 0))
            continue
        masked, truth = simulate_missing_col(df, key, c)
        filled = forest_impute(masked, key, cols, **forest)
        judged = imputation_error(compare_cells(truth, filled, key, [c])).withColumn("ok", accepted(r2_limit, rule)).first()
        rows.append((c, gap, judged["r2"], judged["p_value"], int(judged["ok"])))
        if judged["ok"]:
            fill = filled.select(key, F.col(c).alias("_new"))
            out = replace_columns(out.join(fill, key), {c: F.coalesce(c, "_new")}).drop("_new")
    ledger = df.sparkSession.createDataFrame(rows, "column string, missing double, r2 double, p_value double, accepted int")
    return out, ledger
