"""Where will the running year's mean end? From the rest of the year in earlier years."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.calendar import day_index, year_end, year_length
from isotherm.functions.numbers import quantile_of_sorted
from isotherm.operators.common import in_years, last_days, sums_around, with_value, year_rests
from isotherm.schema import COVERAGE, FORECAST_YEARS, FULL_YEAR

PS = (0.1, 0.5, 0.9)


def year_forecast(c: DataFrame, today: dt.date, compare_years: int = FORECAST_YEARS,
                  min_days: int = FULL_YEAR, share: float = COVERAGE) -> DataFrame:
    """Low, middle and high year-end mean with their places among the full years."""
    running = (
        last_days(c).where(F.col("jahr_letzter") == today.year)
        .select("station", "letzter", F.col("jahr_letzter").alias("lauf"))
        .withColumn("rest", F.datediff(year_end(F.col("lauf")), "letzter"))
        .withColumn("laenge", year_length(F.col("lauf")))
    )
    total = F.coalesce("s_bis", F.lit(0.0)) + F.coalesce("s_nach", F.lit(0.0))
    years = (
        sums_around(c, running.withColumn("ende", F.col("letzter"))).join(running, "station")
        .withColumn("n", F.col("n_bis") + F.col("n_nach"))
        .select("station", "jahr", "lauf", "rest", "laenge", (total / F.col("n")).alias("m"), "n",
                F.when(F.col("n_nach") > 0, F.col("s_nach") / F.col("n_nach")).alias("m_rest"),
                F.col("n_nach").alias("n_rest"))
    )
    is_own = F.col("jahr") == F.col("lauf")
    compared = (
        F.col("jahr").between(F.col("lauf") - compare_years, F.col("lauf") - 1)
        & (F.col("rest") > 0) & (F.col("n_rest") > 0) & (F.col("n_rest") >= F.col("rest") * share)
    )
    full = ~is_own & (F.col("n") >= min_days)
    # at most one row per year of the calendar is left of each station
    per_station = years.groupBy("station", "lauf", "rest", "laenge").agg(
        F.max(F.when(is_own, F.col("m"))).alias("eigen"),
        F.max(F.when(is_own, F.col("n"))).alias("eigen_tage"),
        F.percentile(F.when(compared, F.col("m_rest")), F.array(*map(F.lit, PS))).alias("_q"),
        F.count(F.when(compared, 1)).alias("vergleichsjahre"),
        F.collect_list(F.when(full, F.col("m"))).alias("_voll"))
    so_far = F.col("laenge") - F.col("rest")

    def ending(i):
        mixed = (F.col("eigen") * so_far + F.col("_q")[i] * F.col("rest")) / F.col("laenge")
        return F.when(F.col("rest") == 0, F.col("eigen")).otherwise(mixed)

    def place(value):
        return F.size(F.filter("_voll", lambda v: v > F.col(value))) + 1

    return (
        per_station
        .where((F.col("eigen_tage") >= so_far * share)
               & ((F.col("rest") == 0) | (F.col("vergleichsjahre") > 0)))
        .withColumns({"tief": ending(0), "mitte": ending(1), "hoch": ending(2)})
        .select(
            "station", F.col("lauf").alias("jahr"), "tief", "mitte", "hoch",
            place("mitte").alias("platz"), place("hoch").alias("platz_hoch"),
            place("tief").alias("platz_tief"), (F.size("_voll") + 1).alias("von"),
            "vergleichsjahre", (F.col("lauf") - compare_years).alias("jahre_von"),
            (F.col("lauf") - 1).alias("jahre_bis"), F.col("rest").alias("rest_tage"))
    )


def forecast_trajectory(c: DataFrame, today: dt.date, compare_years: int = FORECAST_YEARS,
                        share: float = COVERAGE) -> DataFrame:
    """What the forecast would have said on every measured day of the running year.

    Every comparison year is one array of its remaining sums, and a station's own year one
    array of days: they meet in one row per station, and no day is paired with a year in rows.
    """
    year = today.year
    running = last_days(c).where(F.col("jahr_letzter") == year).select("station")
    history = in_years(c, year - compare_years, year - 1).join(running, "station", "left_semi")
    rests = year_rests(history, "tmk").groupBy("station").agg(F.collect_list("rest").alias("_jahre"))
    forwards = Window.partitionBy("station", F.year("datum")).orderBy("datum").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end = F.lit(dt.date(year, 12, 31))
    length = F.dayofyear(end)
    own = (
        with_value(in_years(c, year, year), "tmk").join(running, "station", "left_semi")
        .select("station", "datum", day_index(F.col("datum")).alias("k"),
                F.avg("tmk").over(forwards).alias("m"), F.count("tmk").over(forwards).alias("n"),
                F.datediff(end, F.col("datum")).alias("rest"))
        .where((F.col("rest") > 0) & (F.col("n") >= (length - F.col("rest")) * share))
        # at most 366 days
        .groupBy("station").agg(F.collect_list(F.struct("datum", "k", "m", "rest")).alias("_tage"))
    )

    def compared(day):
        left = F.transform("_jahre", lambda j: F.get(j, day["k"] + 1))
        enough = F.filter(left, lambda x: x["a"] >= day["rest"] * share)
        return F.struct(day["datum"].alias("datum"), day["m"].alias("m"), day["rest"].alias("rest"),
                        F.sort_array(F.transform(enough, lambda x: x["s"] / x["a"])).alias("_w"))

    days = own.join(rests, "station").select("station", F.inline(F.transform("_tage", compared)))

    def ending(p):
        rest = quantile_of_sorted(F.col("_w"), p)
        return (F.col("m") * (length - F.col("rest")) + rest * F.col("rest")) / length

    low, middle, high = map(ending, PS)
    return days.where(F.size("_w") > 0).select(
        "station", "datum", low.alias("tief"), middle.alias("mitte"), high.alias("hoch"), "m")
