"""One year against the others: days, months, year-to-date rank, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.calendar import day_index, new_year, year_end
from isotherm.operators.common import in_period, last_days, of_period, of_year, sums_around, with_value
from isotherm.schema import COVERAGE, FULL_YEAR


def year_days(c: DataFrame, jahr: int | None = None) -> DataFrame:
    return of_year(c, jahr).select(
        "station", "jahr", "datum", day_index(F.col("datum")).alias("k"), "tmk", "txk", "tnk"
    )


def months_vs_normal(c: DataFrame, jahr: int | None = None, nv: int = 1991) -> DataFrame:
    """Monthly means of the year beside the mean of the same month in the period."""
    month = F.month("datum").alias("monat")
    own = of_year(c, jahr).groupBy("station", "jahr", month).agg(
        F.avg("tmk").alias("m"), F.count("tmk").alias("tage"))
    usual = of_period(c, nv).groupBy("station", month).agg(F.avg("tmk").alias("normal"))
    return own.join(usual, ["station", "monat"], "left")


def _targets(c: DataFrame, jahr: int | None) -> DataFrame:
    """Per station the year looked at, its last day considered and the span since New Year."""
    year = F.col("jahr_letzter") if jahr is None else F.lit(int(jahr))
    return (
        last_days(c).withColumn("ziel", year)
        .withColumn("ende", F.when(F.col("ziel") == F.col("jahr_letzter"), F.col("letzter"))
                    .otherwise(year_end(F.col("ziel"))))
        .withColumn("spanne", F.datediff("ende", new_year(F.col("ziel"))) + 1)
    )


def ytd_rank(c: DataFrame, jahr: int | None = None, share: float = COVERAGE) -> DataFrame:
    """Place of the year among all years over the same span from 1 January."""
    targets = _targets(c, jahr)
    spans = sums_around(c, targets).where("n_bis > 0").select(
        "station", "jahr", (F.col("s_bis") / F.col("n_bis")).alias("m"), F.col("n_bis").alias("tage"))
    # one row per station and year from here on
    enough = F.col("tage") >= F.col("spanne") * share
    w = Window.partitionBy("station", enough)
    ranked = (
        spans.join(targets.select("station", "ziel", "spanne"), "station")
        .withColumn("platz", F.when(enough, F.row_number().over(
            w.orderBy(F.desc("m"), "jahr"))))
        .withColumn("von", F.sum(F.when(enough, 1).otherwise(0)).over(
            Window.partitionBy("station")))
    )
    own = ranked.groupBy("station").agg(
        F.max(F.when(F.col("jahr") == F.col("ziel"), F.col("m"))).alias("m"),
        F.max(F.when(F.col("jahr") == F.col("ziel"), F.col("tage"))).alias("tage"),
        F.max(F.when(F.col("jahr") == F.col("ziel"), F.col("platz"))).alias("platz"),
        F.max("von").alias("von"))
    return (
        targets.select("station", F.col("ziel").alias("jahr"), "letzter", "ende",
                       (F.col("ziel") == F.col("jahr_letzter")).alias("laufend"))
        .join(own, "station", "left")
        .withColumns({"tage": F.coalesce("tage", F.lit(0)), "von": F.coalesce("von", F.lit(0))})
    )


def _placed(years: DataFrame, nv: int) -> DataFrame:
    """Warmest first, deviation from the mean of the period's years of the same list."""
    whole = Window.partitionBy("station")
    first = whole.orderBy(F.desc("m"), "jahr")
    return years.withColumns({
        "platz": F.row_number().over(first),
        "normal": F.avg(F.when(in_period(nv), F.col("m"))).over(whole),
        "normal_jahre": F.count(F.when(in_period(nv), 1)).over(whole),
    }).withColumn("abw", F.col("m") - F.col("normal"))


def ranking(c: DataFrame, mode: str = "heute", nv: int = 1991, forecast: DataFrame | None = None,
            min_days: int = FULL_YEAR, share: float = COVERAGE) -> DataFrame:
    """All years by mean.

    ``heute``: every year from 1 January to the calendar day of the last measurement.
    ``jahr``: full years without the last measured one; with ``forecast`` (result of
    ``year_forecast``) the running year enters at its median with low and high.
    """
    rows = with_value(c, "tmk").select("station", "datum", "tmk")
    last = last_days(c)
    if mode == "heute":
        span = F.datediff("letzter", new_year(F.col("jahr_letzter"))) + 1
        years = (
            sums_around(c, last.withColumn("ende", F.col("letzter"))).where("n_bis > 0")
            .join(last.select("station", span.alias("spanne")), "station")
            .where(F.col("n_bis") >= F.col("spanne") * share)
            .select("station", "jahr", (F.col("s_bis") / F.col("n_bis")).alias("m"), F.col("n_bis").alias("tage"))
        )
        return _placed(years, nv)
    years = (
        rows.groupBy("station", F.year("datum").alias("jahr"))
        .agg(F.avg("tmk").alias("m"), F.count("tmk").alias("tage"))
        .where(F.col("tage") >= min_days)
        .join(last.select("station", "jahr_letzter"), "station")
        .where(F.col("jahr") != F.col("jahr_letzter")).drop("jahr_letzter")
    )
    years = years.withColumns({
        "prognose": F.lit(False), "tief": F.lit(None).cast("double"),
        "hoch": F.lit(None).cast("double")})
    if forecast is not None:
        # the running year enters with two digits, as it is published
        years = years.unionByName(forecast.select(
            "station", "jahr", F.round(F.round("mitte", 9), 2).alias("m"),
            F.lit(None).cast("bigint").alias("tage"), F.lit(True).alias("prognose"),
            F.round(F.round("tief", 9), 2).alias("tief"),
            F.round(F.round("hoch", 9), 2).alias("hoch")))
    return _placed(years, nv)


def sort_table(df: DataFrame, column: str, descending: bool = False,
               place: str = "platz") -> DataFrame:
    """Order by any column: NULL last, equal values by place."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.asc(place))
