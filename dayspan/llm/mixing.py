"""Mixing sources to target weights by weighted sampling without replacement.

Every row gets an exponential key scaled by its quality weight (Efraimidis-Spirakis): rows in
order of their keys are a weighted sample of any length. A source first gives all its rows as
often as its target holds its whole size, then rows in key order up to the rest of the target.

A source may hold any share of the rows. Its rows are parted into slices of the key's logarithm,
one total per slice gives each slice's offset, and only rows of one slice are sorted together.
Rows of one weight spread over ``PER_OCTAVE`` slices for each doubling of the key whatever the
weight is, so no slice gets much more than a ``2 / PER_OCTAVE`` part of them.

Null sources are one source, ordered last; null, negative or zero weights count as the
smallest weight; null sizes are 0; rows with equal ids share a key and are ordered by size;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_WEIGHT = 1e-6
PER_OCTAVE = 1024


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{seed}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**48)


def source_targets(sources: DataFrame, cycle: list[float], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source.

    Weights of ``cycle`` go to the sources by code point, nulls last, again and again. Targets
    sum up to ``share`` of all sizes; none exceeds ``cap`` times its source's size, and what is
    over goes to the others by weight. Sources in order of cap / weight: those that the share
    left by the earlier ones fills up to the cap come first, all others get one rate.
    """
    everything, before = Window.partitionBy(), Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    rows = sources.withColumn("place", place)
    rows = rows.withColumn("weight", F.element_at(weights, ((F.col("place") - 1) % len(cycle) + 1).cast("int")))
    rows = rows.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    rows = rows.withColumn("full_at", F.col("most") / F.col("weight"))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rows = rows.withColumn("rate", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    common = F.min(F.when(F.col("full_at") > F.col("rate"), F.struct("full_at", "place", "rate"))).over(everything)["rate"]
    target = F.when(F.col("full_at") <= F.col("rate"), F.col("most")).otherwise(F.least(F.col("most"), common * F.col("weight")))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def mix(rows: DataFrame, cycle: list[float], share: float, cap: float, seed: int, slices: int = PER_OCTAVE) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of (id, source, size, weight).

    The row that crosses the rest of a target is taken if that brings the source nearer to it.
    """
    rows = rows.select(
        "id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"),
        (-F.log(uniform(F.col("id"), seed)) / F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(LEAST_WEIGHT))).alias("key"),
    ).withColumn("slice", F.floor(F.log2("key") * slices).cast("int"))
    totals = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("slice_size").alias("source_size")), cycle, share, cap)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    t = targets.withColumnRenamed("source", "t_source")
    offsets = offsets.join(t, offsets["source"].eqNullSafe(t["t_source"])).drop("t_source", "slice_size")
    offsets = offsets.withColumnsRenamed({"source": "o_source", "slice": "o_slice"})
    joined = rows.join(offsets, (rows["slice"] == offsets["o_slice"]) & rows["source"].eqNullSafe(offsets["o_source"]))
    in_order = Window.partitionBy("o_source", "o_slice").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("size").over(in_order) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    copies = epochs + F.when(start + F.col("size") / 2 <= rest, 1).otherwise(0)
    out = joined.withColumn("copies", copies)
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
