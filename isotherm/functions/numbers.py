"""Rounding, units and exact quantiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.schema import KMH, WIND


def displayed(value: Column, digits: int = 1) -> Column:
    """Nine digits first, so that summation noise cannot flip a value lying on a half."""
    return F.round(F.round(value, 9), digits)


def round_for_display(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    return df.withColumns({c: displayed(F.col(c), n) for c, n in digits.items()})


def to_display_units(df: DataFrame, columns: Sequence[str] = tuple(WIND)) -> DataFrame:
    """Wind is stored in m/s and shown in km/h."""
    return df.withColumns({c: F.col(c) * KMH for c in columns if c in df.columns})


def quantiles(df: DataFrame, keys: Sequence[str], column: str, ps: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles per group.

    Equal values are counted before the shuffle to the group, so a heavy group arrives as
    (value, count) pairs and not as its rows.
    """
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, column)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    q = F.percentile(F.col(column), F.array(*[F.lit(float(p)) for p in ps]), F.col("n"))
    return counted.groupBy(*keys).agg(q.alias("q"), F.sum("n").alias("n"))


def quantile_of_sorted(values: Column, p: float) -> Column:
    """Linear interpolation at (n-1)*p inside an ascending array."""
    at = (F.size(values) - 1) * F.lit(float(p))
    low = F.try_element_at(values, F.floor(at).cast("int") + 1)
    high = F.try_element_at(values, F.ceil(at).cast("int") + 1)
    return F.when(F.size(values) > 0, low + (high - low) * (at - F.floor(at)))


def rounded(value: Column, digits: int = 1) -> Column:
    """Nearest value with 0 or 1 digits of the exact binary number, a true half to the even one.

    Rounding the shortest decimal text would take 0.15, which is a little less, for a half. The
    twentyfold is split into its double and the exact rest (the factor has few bits, so halves of
    the value times 20 are exact): an odd whole number is a half, unless the rest says otherwise.
    """
    if digits == 0:
        return F.rint(value)
    if digits != 1:
        raise ValueError(digits)
    twenty = value * 20
    high = value * 134217729.0 - (value * 134217729.0 - value)
    rest = (high * 20 - twenty) + (value - high) * 20
    tenth = F.floor((twenty + 1) / 2)
    half = F.pmod(twenty, F.lit(2.0)) == 1.0
    down = half & ((rest < 0) | ((rest == 0) & (F.pmod(tenth, F.lit(2)) == 1)))
    return F.when(down, tenth - 1).otherwise(tenth) / F.lit(10.0)
