"""Ranks, running totals and quantiles that never sort a whole table in one task.

A window without a partition key, or with one hot key, puts all its rows in one
task. Here the ordering value is cut into range slices, each slice is sorted on
its own, and the slice totals (a table of slices, not rows) give the offsets.
There are as many slices as the session has shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayspan.session import cut_lineage, shuffle_width

_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place below the partition's number


def running_totals(
    counts: DataFrame, by: Sequence[str], value: str, weights: Sequence[str], slices: int | None = None
) -> DataFrame:
    """Add ``cum_{w}`` (total of w up to and with the value) and ``tot_{w}``.

    ``counts`` holds one row per (by, value): pre-aggregate first, so a value
    shared by very many rows arrives here as a single row. It is evaluated once;
    Spark's range partitioner cuts it by value, then by group.
    """
    by = list(by)
    ranged = cut_lineage(counts).repartitionByRange(slices or shuffle_width(counts), value, *by)
    sliced = ranged.withColumn("_slice", F.spark_partition_id())
    inner = (
        Window.partitionBy(*by, "_slice")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = cut_lineage(sliced.select("*", *[F.sum(w).over(inner).alias(f"_c_{w}") for w in weights]))
    # One row per group and slice; the window below sees slices, not data rows.
    totals = local.groupBy(*by, "_slice").agg(*[F.sum(w).alias(f"_s_{w}") for w in weights])
    anchor = [F.col(c) for c in by] or [F.lit(1)]
    before = Window.partitionBy(*anchor).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*anchor)
    keys = [*by, "_slice"]
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_s_{w}").over(before), F.lit(0)).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_s_{w}").over(whole).alias(f"tot_{w}") for w in weights],
    )
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return local.join(offsets, match).select(
        *counts.columns,
        *[(F.col(f"_o_{w}") + F.col(f"_c_{w}")).alias(f"cum_{w}") for w in weights],
        *[F.col(f"tot_{w}") for w in weights],
    )


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    uniform: tuple[float, float] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Row number from 1 over the whole table by ``order``; adds ``{name}_of`` (row count).

    Spark's range partitioner cuts the rows by all order columns, so the rows of
    a frequent first value are parted by the next ones; a row's number is its
    place in its slice after the rows of the slices before. ``uniform`` states the
    range of an evenly spread column, such as a hash, and saves the pass that
    finds the cuts. The table is evaluated once.
    """
    slices = slices or shuffle_width(df)
    if uniform is not None:
        low, high = uniform
        cut = F.floor((F.col(order[0]) - low) * slices / (high - low)).cast("int")
        inside = Window.partitionBy("_slice").orderBy(*order)
        placed = df.withColumn("_slice", F.coalesce(cut, F.lit(-1))).withColumn("_rn", F.row_number().over(inside))
    else:
        ranged = cut_lineage(df).repartitionByRange(slices, *order).sortWithinPartitions(*order)
        place = ranged.withColumn("_m", F.monotonically_increasing_id())
        placed = place.select(
            *df.columns,
            F.shiftright("_m", _ROW_BITS).cast("int").alias("_slice"),
            (F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).alias("_rn"),
        )
    placed = cut_lineage(placed)
    per_slice = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy(F.lit(1)).orderBy("_slice")  # slices, not rows
    offsets = per_slice.select(
        F.col("_slice").alias("_k"),
        F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(F.lit(1))).alias(f"{name}_of"),
    )
    return placed.join(F.broadcast(offsets), F.col("_slice") == F.col("_k")).select(  # one row a slice: no row is written again
        *df.columns, (F.col("_before") + F.col("_rn")).alias(name), f"{name}_of"
    )


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), keep: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per (by, keep, value): ``n`` rows, ``ties`` and their shared average ``rank``.

    ``weight`` names a column that says how many rows a row stands for.
    """
    by, keep = list(by), list(keep)
    fine = df.filter(F.col(value).isNotNull()).groupBy(*by, *keep, value).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n")
    )
    tied = fine.groupBy(*by, value).agg(F.sum("n").alias("ties"))
    ranked = running_totals(tied, by, value, ["ties"]).select(
        *by, value, "ties", "tot_ties",
        (F.col("cum_ties") - F.col("ties") + (F.col("ties") + 1) / 2).alias("rank"),
    )
    if not keep:
        return ranked.withColumn("n", F.col("ties"))
    return fine.join(ranked, [*by, value])


def group_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per entry of ``probs``.

    ``percentile`` keeps all distinct values of a group in one buffer; this reads
    the two neighbouring order statistics off the running counts instead. ``weight``
    names the count column of a table that has one row per (by, value) already.
    """
    by = list(by)
    known = df.filter(F.col(value).isNotNull())
    if weight is None:
        counts = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = known.select(*by, value, F.col(weight).alias("n"))
    ranked = running_totals(counts, by, value, ["n"])
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n")
    picks, result = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("tot_n") - 1)
        low, high = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when((first <= low) & (low < last), F.col(value))).alias(f"_{name}_lo"),
            F.max(F.when((first <= high) & (high < last), F.col(value))).alias(f"_{name}_hi"),
            F.max(at - low).alias(f"_{name}_w"),
        ]
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        result.append((lo + (hi - lo) * F.col(f"_{name}_w")).alias(name))
    return ranked.groupBy(*by).agg(*picks, F.max("tot_n").alias("n")).select(*by, "n", *result)
