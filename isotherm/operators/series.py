"""Coverage and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.calendar import mid_day, mid_month, mid_year, month_length
from isotherm.operators.common import with_neighbours, with_previous_day, with_value
from isotherm.schema import COVERAGE, FULL_YEAR, JUMP, SMOOTHING


def coverage(obs: DataFrame) -> DataFrame:
    return obs.groupBy("station").agg(
        F.min("datum").alias("von"), F.max("datum").alias("bis"),
        F.count(F.lit(1)).alias("tage"))


def years(c: DataFrame) -> DataFrame:
    """Years with any temperature."""
    measured = F.coalesce("tmk", "txk", "tnk").isNotNull()
    return c.where(measured).select("station", F.year("datum").alias("jahr")).distinct()


def station_overview(st: DataFrame, obs: DataFrame) -> DataFrame:
    """The dimension with the number of loaded days, in German order of names."""
    loaded = obs.groupBy(F.col("station").alias("id")).agg(F.count(F.lit(1)).alias("tage"))
    return (
        st.join(loaded, "id", "left")
        .select("id", "name", "land", "hoehe", F.year("von").alias("von"), "bis",
                F.coalesce("tage", F.lit(0)).alias("tage"), "lat", "lon")
        .orderBy(F.collate("name", "de"), "id")
    )


def daily_series(c: DataFrame, column: str = "tmk") -> DataFrame:
    """t (unix seconds at noon), wert, and the previous value where the step is a jump."""
    rows = with_previous_day(c.select("station", "datum", column), column)
    leap = F.abs(F.col(column) - F.col("vorher")) > JUMP
    return rows.select(
        "station", "datum", mid_day(F.col("datum")).alias("t"), F.col(column).alias("wert"),
        F.when(leap, F.col("vorher")).alias("sprung"))


def with_gaps(df: DataFrame, step: int, keys: tuple[str, ...] = ("station",)) -> DataFrame:
    """Where the next point is more than ``step`` seconds away, a point without a value.

    Neighbours are found inside blocks of 512 steps and across the edges of the blocks.
    """
    points = df.select(*keys, "t", "wert")
    rows = with_neighbours(points, list(keys), "t", F.floor(F.col("t") / (512 * step)))
    here = F.struct("t", "wert")
    gap = F.struct((F.col("t") + step).alias("t"), F.lit(None).cast("double").alias("wert"))
    points = F.when(F.col("danach") - F.col("t") > step, F.array(here, gap)).otherwise(
        F.array(here))
    return rows.select(*keys, F.explode(points).alias("p")).select(*keys, "p.t", "p.wert")


def monthly_series(c: DataFrame, column: str = "tmk", share: float = COVERAGE) -> DataFrame:
    month = F.trunc("datum", "month")
    return (
        with_value(c, column).groupBy("station", month.alias("monat"))
        .agg(F.avg(column).alias("wert"), F.count(F.lit(1)).alias("tage"))
        .where(F.col("tage") >= month_length(F.col("monat")) * share)
        .withColumn("t", mid_month(F.col("monat")))
    )


def yearly_means(c: DataFrame, column: str = "tmk", min_days: int = FULL_YEAR) -> DataFrame:
    """Means of full years."""
    return (
        with_value(c, column).groupBy("station", F.year("datum").alias("jahr"))
        .agg(F.avg(column).alias("m"), F.count(F.lit(1)).alias("tage"))
        .where(F.col("tage") >= min_days)
    )


def yearly_series(c: DataFrame, column: str = "tmk", min_days: int = FULL_YEAR,
                  reach: int = SMOOTHING) -> DataFrame:
    """Yearly means and their centred moving mean over the years within ``reach``."""
    w = Window.partitionBy("station").orderBy("jahr").rangeBetween(-reach, reach)
    return yearly_means(c, column, min_days).select(
        "station", "jahr", mid_year(F.col("jahr")).alias("t"), F.col("m").alias("wert"),
        F.avg("m").over(w).alias("glatt"))
