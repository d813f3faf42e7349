"""Column expressions used across operators. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dayspan.spec import SEASONS


def band(col: Column, bands: Sequence[tuple], default: int | None = None) -> Column:
    """Code of the first closed interval that holds the value, else ``default``."""
    expr = None
    for low, high, code in bands:
        hit = col >= F.lit(low) if high is None else col.between(low, high)
        expr = F.when(hit, F.lit(code)) if expr is None else expr.when(hit, F.lit(code))
    return expr.otherwise(F.lit(default).cast("int"))


def mask_below(col: Column, threshold) -> Column:
    """Missing where the value is under the threshold."""
    return F.when(col >= F.lit(threshold), col)


def mask_upto(col: Column, threshold) -> Column:
    """Missing where the value is at or under the threshold."""
    return F.when(col > F.lit(threshold), col)


def positive(col: Column) -> Column:
    """1 for values over zero, 0 for the rest, missing included."""
    return F.coalesce(col > 0, F.lit(False)).cast("int")


def item_total(cols: Iterable[Column]) -> Column:
    """Row sum of integer items, a missing item counting as zero."""
    return reduce(lambda a, b: a + b, (F.coalesce(c.cast("int"), F.lit(0)) for c in cols))


def any_true(conditions: Iterable[Column]) -> Column:
    """1 if one condition holds; an unknown condition counts as false."""
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions)).cast("int")


def cohort(col: Column, mark: str = "EN0", marked: str = "V2", other: str = "V1") -> Column:
    return F.when(col.contains(mark), F.lit(marked)).otherwise(F.lit(other))


def season(month: Column) -> Column:
    expr = None
    for name, months in SEASONS.items():
        hit = month.isin(*months)
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
    return expr


def season_code(label: Column) -> Column:
    names = F.array(*[F.lit(n) for n in SEASONS])
    return F.when(label.isNotNull(), F.array_position(names, label).cast("int"))


def finite_or_missing(col: Column) -> Column:
    """NaN and both infinities become missing."""
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


def finite_or_unit(col: Column) -> Column:
    """+Inf to 1, -Inf to -1, NaN and missing to 0: the rule for correlations."""
    return (
        F.when(col.isNull() | F.isnan(col), F.lit(0.0))
        .when(col == F.lit(float("inf")), F.lit(1.0))
        .when(col == F.lit(float("-inf")), F.lit(-1.0))
        .otherwise(col)
    )


def lookup(col: Column, values: dict) -> Column:
    """Value of a small fixed mapping as a chain of comparisons, which stays in generated code."""
    expr = None
    for key, value in values.items():
        expr = F.when(col == key, F.lit(value)) if expr is None else expr.when(col == key, F.lit(value))
    return expr


def safe_corr(a: str, b: str) -> Column:
    """Pearson r over rows where both are known; missing where one does not vary.

    The built-in ``corr`` raises a division error for a constant column in ANSI mode.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, F.col(a))) * F.var_pop(F.when(both, F.col(b))))
    r = F.try_divide(F.covar_pop(a, b), spread)
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


# Multipliers and shifts of the hash, repeated in the SQL counterparts.
HASH_FIRST, HASH_SECOND, HASH_SEED = 2654435761, 2146121005, 40503
HASH_SPAN, HASH_FOLD = 4294967296, 2147483648


def stable_hash(key: Column, seed: int = 42) -> Column:
    """Hash of a non-negative integer key in [0, 2**32), the same in every engine.

    Plain integer arithmetic: multiply, mix the high bits down, multiply again.
    The key is folded first so that every product stays inside 64 bits.
    """
    h = (key.cast("long") % HASH_FOLD * HASH_FIRST + seed * HASH_SEED) % HASH_SPAN
    h = h.bitwiseXOR(F.shiftright(h, 15)) * HASH_SECOND % HASH_SPAN
    return h.bitwiseXOR(F.shiftright(h, 13))
