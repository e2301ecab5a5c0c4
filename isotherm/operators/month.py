"""One month day by day with its sum and its normal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.functions.calendar import day_index
from isotherm.operators.common import in_years, of_period
from isotherm.operators.normals import day_means
from isotherm.schema import COVERAGE, KMH, MONTH, SUMMED, WIND

VALUES = [m for m in MONTH if m != "rskf"]


def measured_span(c: DataFrame) -> DataFrame:
    """First and last day with a mean or rain; its month is the default month."""
    return (
        c.where(F.coalesce("tmk", "rsk").isNotNull()).groupBy("station")
        .agg(F.min("datum").alias("erster"), F.max("datum").alias("letzter"))
        .withColumns({"jahr": F.year("letzter"), "monat": F.month("letzter")})
    )


def _of_month(c: DataFrame, jahr: int | None, monat: int | None) -> DataFrame:
    if jahr and monat:
        return in_years(c, jahr, jahr).where(F.month("datum") == monat).withColumns(
            {"jahr": F.lit(int(jahr)), "monat": F.lit(int(monat))})
    first = F.make_date("jahr", "monat", F.lit(1))
    return c.join(measured_span(c).select("station", "jahr", "monat"), "station").where(
        F.col("datum").between(first, F.last_day(first)))


def _shown(column: str):
    return (F.col(column) * KMH if column in WIND else F.col(column)).alias(column)


def month_days(c: DataFrame, jahr: int | None = None, monat: int | None = None,
               nv: int = 1991) -> DataFrame:
    """Every day of the month with all measures, wind in km/h, and the deviation of the mean."""
    usual = day_means(c, ["tmk"], nv).withColumnRenamed("tmk", "_normal")
    return (
        _of_month(c, jahr, monat).withColumn("k", day_index(F.col("datum")))
        .join(usual, ["station", "k"], "left")
        .select("station", "jahr", "monat", F.day("datum").alias("tag"), *map(_shown, MONTH),
                (F.col("tmk") - F.col("_normal")).alias("abw"))
    )


def month_summary(c: DataFrame, jahr: int | None = None, monat: int | None = None) -> DataFrame:
    """Mean per measure, the sum for rain and sun, and the days behind each."""
    totals = [(F.sum if m in SUMMED else F.avg)(m).alias(m) for m in VALUES]
    rows = _of_month(c, jahr, monat).groupBy("station", "jahr", "monat").agg(
        F.max(F.day("datum")).alias("bis_tag"), *totals,
        *[F.count(m).alias(f"n_{m}") for m in VALUES])
    return rows.select("station", "jahr", "monat", "bis_tag", *map(_shown, VALUES),
                       *[f"n_{m}" for m in VALUES])


def month_normal(c: DataFrame, jahr: int | None = None, monat: int | None = None,
                 nv: int = 1991, share: float = COVERAGE) -> DataFrame:
    """The same days of the same month in the period.

    One pass: sums and counts per (station, year), then the mean over all days from those
    sums, and for rain and sun the mean of the yearly sums with enough days.
    """
    last = F.max(F.day("datum")).alias("bis_tag")
    wanted = _of_month(c, jahr, monat).groupBy("station", "monat").agg(last)
    if jahr and monat:
        # stations without a day in the month are measured against the whole month
        wanted = c.select("station").distinct().join(wanted, "station", "left").select(
            "station", F.lit(int(monat)).alias("monat"),
            F.coalesce("bis_tag", F.lit(31)).alias("bis_tag"))
    years = (
        of_period(c, nv).join(wanted, "station")
        .where((F.month("datum") == F.col("monat")) & (F.day("datum") <= F.col("bis_tag")))
        .groupBy("station", "monat", "bis_tag", F.year("datum").alias("_j"))
        .agg(*[F.sum(m).alias(f"s_{m}") for m in VALUES],
             *[F.count(m).alias(f"n_{m}") for m in VALUES])
    )

    def usual(m):
        if m in SUMMED:
            enough = F.col(f"n_{m}") >= F.col("bis_tag") * share
            return F.avg(F.when(enough, F.col(f"s_{m}"))).alias(m)
        return F.try_divide(F.sum(f"s_{m}"), F.sum(f"n_{m}")).alias(m)

    out = years.groupBy("station", "monat", "bis_tag").agg(
        *map(usual, VALUES), F.count_if(F.col("n_tmk") > 0).alias("normal_jahre"))
    return out.select("station", "monat", "bis_tag", *map(_shown, VALUES), "normal_jahre")
