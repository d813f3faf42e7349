"""Pearson structure in long form: (var_i, var_j, r), never a matrix per person."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.functions.columns import lookup

# Columns of a tile: the correlations of two tiles are one row of aggregates.
TILE = 4
# Up to this number of pairs a row of the table is aggregated as it is.
DIRECT = 16


def _pairs(cols: Sequence[str], diagonal: bool) -> list[tuple[str, str]]:
    pairs = list(combinations(cols, 2))
    return pairs + [(c, c) for c in cols] if diagonal else pairs


def _long(df: DataFrame, by: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """r of every pair over its pairwise-complete rows, in long form, in one scan for any width.

    Columns are cut into tiles. A row becomes one row for each pair of tiles that is needed, and
    one aggregate for each position of two tiles; sums are merged before the shuffle, so neither
    a person with very many rows nor a task that meets very many persons is held as a whole.
    """
    by, pairs = list(by), list(pairs)
    if len(pairs) <= DIRECT:
        wide = df.groupBy(*by).agg(*[_corr(F.col(x), F.col(y)).alias(f"_r{i}") for i, (x, y) in enumerate(pairs)])
        cells = [F.struct(F.lit(x).alias("var_i"), F.lit(y).alias("var_j"), _own(F.col(f"_r{i}"), F.lit(x == y)).alias("r")) for i, (x, y) in enumerate(pairs)]
        return wide.select(*by, F.inline(F.array(*cells)))
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    place = {c: i for i, c in enumerate(cols)}
    tiles = [cols[i:i + TILE] for i in range(0, len(cols), TILE)]
    asked = sorted({(place[x] // TILE, place[y] // TILE) for x, y in pairs})
    values = [F.array(*[F.col(c).cast("double") for c in tile]) for tile in tiles]
    tile_at = F.transform(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in asked]), lambda t: F.struct(t[0].alias("_a"), t[1].alias("_b")))
    rows = df.select(*by, F.array(*values).alias("_v"), F.explode(tile_at).alias("_t"))
    rows = rows.select(*by, "_t", F.element_at("_v", F.col("_t._a") + 1).alias("_x"), F.element_at("_v", F.col("_t._b") + 1).alias("_y"))
    spots = [(i, j) for i in range(TILE) for j in range(TILE)]
    wide = rows.groupBy(*by, "_t").agg(*[_corr(F.get("_x", F.lit(i)), F.get("_y", F.lit(j))).alias(f"_r{i}_{j}") for i, j in spots])
    cells = F.array(*[F.struct((F.col("_t._a") * TILE + i).alias("_i"), (F.col("_t._b") * TILE + j).alias("_j"), F.col(f"_r{i}_{j}").alias("r")) for i, j in spots])
    names = F.array(*[F.lit(c) for c in cols])
    wanted = F.create_map(*[x for i, j in sorted({(place[x], place[y]) for x, y in pairs}) for x in (F.lit(i * len(cols) + j), F.lit(True))])
    long = wide.select(*by, F.inline(cells)).filter((F.col("_i") < len(cols)) & (F.col("_j") < len(cols)) & wanted[F.col("_i") * len(cols) + F.col("_j")])
    names = [F.element_at(names, F.col(c) + 1).alias(n) for c, n in (("_i", "var_i"), ("_j", "var_j"))]
    return long.select(*by, *names, _own(F.col("r"), F.col("_i") == F.col("_j")).alias("r"))


def _own(r: Column, same: Column) -> Column:
    """r of a column with itself is 1 without rounding."""
    return F.when(same & r.isNotNull(), F.lit(1.0)).otherwise(r)


def _corr(x: Column, y: Column) -> Column:
    """Pearson's r in [-1, 1]; null if either side does not vary or fewer than two rows are complete."""
    both = x.isNotNull() & y.isNotNull()
    sides = [F.when(both, c) for c in (x, y)]
    spread = F.sqrt(F.var_pop(sides[0])) * F.sqrt(F.var_pop(sides[1]))
    r = F.nanvl(F.try_divide(F.covar_pop(x, y), spread), F.lit(None).cast("double"))
    varies = (F.min(sides[0]) < F.max(sides[0])) & (F.min(sides[1]) < F.max(sides[1]))  # a mean of equal values is rounded
    return F.when(varies & r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


def corr_matrix(df: DataFrame, cols: Sequence[str], diagonal: bool = False) -> DataFrame:
    return _long(df, [], _pairs(cols, diagonal))


def symmetric(long: DataFrame, by: Sequence[str] = (), value: str = "r") -> DataFrame:
    """Add the mirrored half to an upper triangle with diagonal."""
    flipped = long.filter("var_i != var_j").select(*by, F.col("var_j").alias("var_i"), F.col("var_i").alias("var_j"), value)
    return long.select(*by, "var_i", "var_j", value).unionByName(flipped)


def person_corr(df: DataFrame, cols: Sequence[str], key: str = "num_id", diagonal: bool = False) -> DataFrame:
    """Correlations inside each person; unknown becomes 0, persons without any variation go."""
    long = _long(df, [key], _pairs(cols, True))
    varies = F.max(F.when(F.col("var_i") == F.col("var_j"), F.coalesce("r", F.lit(0.0)))).over(Window.partitionBy(key))
    out = long.withColumn("_v", varies).filter("_v > 0")
    if not diagonal:
        out = out.filter("var_i != var_j")
    return out.select(key, "var_i", "var_j", F.coalesce("r", F.lit(0.0)).alias("r"))


def upper_triangle(long: DataFrame, cols: Sequence[str], key: str = "num_id") -> DataFrame:
    """Each person's upper triangle as one vector in column order (p(p-1)/2 numbers)."""
    order = {c: i for i, c in enumerate(cols)}
    at = lookup(F.col("var_i"), order) * len(cols) + lookup(F.col("var_j"), order)
    cells = F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col("r"))))
    return long.filter("var_i != var_j").groupBy(key).agg(F.transform(cells, lambda x: x["r"]).alias("vector"))


def mean_distance(long: DataFrame) -> DataFrame:
    """1 minus the mean correlation over persons."""
    return long.groupBy("var_i", "var_j").agg((1 - F.avg("r")).alias("d"))


def person_mean_distance(df: DataFrame, cols: Sequence[str], key: str = "num_id") -> DataFrame:
    """1 - r between person means, from rows complete in the columns."""
    means = df.na.drop("any", subset=list(cols)).groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])
    return corr_matrix(means, cols).select("var_i", "var_j", (1 - F.col("r")).alias("d"))


def corr_edges(long: DataFrame, threshold: float = 0.5, scale: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Network edges above the threshold: weight 5r and sign; optional widths 1..10."""
    edges = long.filter((F.col("var_i") != F.col("var_j")) & (F.abs("r") > threshold)).select(
        *by,
        F.col("var_i").alias("node_a"),
        F.col("var_j").alias("node_b"),
        (F.col("r") * 5).alias("weight"),
        F.when(F.col("r") < 0, -1).otherwise(1).alias("sign"),
    )
    if not scale:
        return edges
    whole = Window.partitionBy(*(by or [F.lit(1)]))  # edges number at most p(p-1)/2
    lo, hi = F.min("weight").over(whole), F.max("weight").over(whole)
    width = F.when(hi == lo, F.lit(5.0)).otherwise((F.col("weight") - lo) / F.nullif(hi - lo, F.lit(0.0)) * 9 + 1)
    return edges.withColumn("width", width)


def target_corr(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """r of every column with the target, strongest first."""
    long = _long(df, [], [(c, target) for c in cols])
    return long.select(F.col("var_i").alias("variable"), "r").orderBy(F.desc(F.abs("r")))


def shape_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population skewness, its bias-corrected form, and excess kurtosis per column."""
    wide = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in cols],
        *[F.skewness(c).alias(f"s_{c}") for c in cols],
        *[F.kurtosis(c).alias(f"k_{c}") for c in cols],
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("skew"), F.col(f"k_{c}").alias("kurtosis")) for c in cols]
    )
    n = F.col("n")
    return wide.select(F.explode(cells).alias("p")).select(
        "p.variable", "p.n", "p.skew", "p.kurtosis"
    ).withColumn("skew_adjusted", F.when(n > 2, F.col("skew") * F.sqrt(n * (n - 1)) / (n - 2)))
