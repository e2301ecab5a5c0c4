"""Rain and sun: totals per year, cumulative curves, months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.calendar import month_length
from isotherm.functions.numbers import displayed, quantile_of_sorted
from isotherm.operators.common import (
    in_period, of_period, of_year, with_first_dates, with_value, year_curves,
)
from isotherm.operators.waves import longest_dry
from isotherm.schema import COVERAGE, FULL_YEAR, WET


def totals_with_end(c: DataFrame, column: str) -> DataFrame:
    """The yearly totals, and ``ende``: the year's last day with a value."""
    v = F.col(column)
    rows = c.groupBy("station", F.year("datum").alias("jahr")).agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("summe"), F.count(v).alias("tage"),
        F.count_if(v >= WET).alias("nass"), F.max(v).alias("max"),
        F.max(F.when(v.isNotNull(), F.col("datum"))).alias("ende"))
    rows = with_first_dates(rows, c, {"station": F.col("station"), "jahr": F.year("datum")},
                            {"max_datum": (column, "max")})
    rows = rows.select(
        "station", "jahr", "summe", "tage",
        ("nass" if column == "rsk" else F.lit(None).cast("bigint").alias("nass")),
        "max", "max_datum", "ende")
    if column != "rsk":
        return rows.withColumns({"trocken": F.lit(None).cast("int"),
                                 "trocken_von": F.lit(None).cast("date")})
    return rows.join(longest_dry(c), ["station", "jahr"], "left").withColumn(
        "trocken", F.coalesce("trocken", F.lit(0)))


def yearly_totals(c: DataFrame, column: str = "rsk") -> DataFrame:
    """Sum, days, wet days and largest day; for rain also the longest dry spell."""
    return totals_with_end(c, column).drop("ende")


def placed(years: DataFrame, nv: int, min_days: int) -> DataFrame:
    """Years with place, mean and number of years of the period; years that are not full have no place."""
    full, whole = F.col("tage") >= min_days, Window.partitionBy("station")
    first = Window.partitionBy("station", full).orderBy(displayed(F.col("summe"), 1).desc(), F.col("jahr"))
    usual = F.when(full & in_period(nv), F.col("summe"))
    return years.withColumns({
        "platz": F.when(full, F.row_number().over(first)),
        "normal": F.avg(usual).over(whole),
        # none where a station has no full year at all
        "normal_jahre": F.when(F.max(full).over(whole), F.count(usual).over(whole)),
    })


def totals_rank(c: DataFrame, column: str = "rsk", nv: int = 1991,
                min_days: int = FULL_YEAR) -> DataFrame:
    """Full years by displayed sum, earlier year first among equals; mean of the period."""
    years = (
        with_value(c, column).groupBy("station", F.year("datum").alias("jahr"))
        .agg(F.sum(column).alias("summe"), F.count(F.lit(1)).alias("tage"))
    )
    return placed(years.where(F.col("tage") >= min_days), nv, min_days)


def cumulative(c: DataFrame, column: str = "rsk", jahr: int | None = None) -> DataFrame:
    """The year's curve up to its last day with a value; a missing day adds nothing."""
    curves = year_curves(of_year(c, jahr, column).drop("jahr"), column)
    return curves.select("station", "jahr", F.posexplode("kurve").alias("k", "kumuliert"))


def cumulative_band(c: DataFrame, column: str = "rsk", nv: int = 1991,
                    min_days: int = FULL_YEAR) -> DataFrame:
    """10, 50 and 90 % over the curves of the period's full years (at most thirty a station)."""
    full = year_curves(of_period(c, nv), column).where(F.col("tage") >= min_days)
    bundles = full.groupBy("station").agg(F.collect_list("kurve").alias("_k"))

    def at(k):
        values = F.transform("_k", lambda a: F.get(a, F.least(k, F.size(a) - 1)))
        return F.struct(k.alias("k"), F.sort_array(values).alias("_w"))

    days = bundles.select("station", F.inline(F.transform(F.sequence(F.lit(0), F.lit(365)), at)))
    w = F.col("_w")
    return days.select(
        "station", "k", quantile_of_sorted(w, 0.1).alias("p10"), quantile_of_sorted(w, 0.5).alias("p50"),
        quantile_of_sorted(w, 0.9).alias("p90"), F.size(w).cast("bigint").alias("jahre"))


def monthly_totals(c: DataFrame, column: str = "rsk", jahr: int | None = None, nv: int = 1991,
                   share: float = COVERAGE) -> DataFrame:
    """Month sums of the year and the mean of the period's months with enough days."""
    month = F.month("datum").alias("monat")
    own = with_value(of_year(c, jahr, column), column).groupBy("station", "jahr", month).agg(
        F.sum(column).alias("summe"), F.count(F.lit(1)).alias("tage"))
    usual = (
        with_value(of_period(c, nv), column)
        .groupBy("station", F.year("datum").alias("_j"), month)
        .agg(F.sum(column).alias("_s"), F.count(F.lit(1)).alias("_n"),
             F.max(month_length(F.col("datum"))).alias("_l"))
        .where(F.col("_n") >= F.col("_l") * share)
        .groupBy("station", "monat").agg(F.avg("_s").alias("normal"))
    )
    return own.join(usual, ["station", "monat"], "left")
