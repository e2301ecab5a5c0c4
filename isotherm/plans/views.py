"""Several operators over one cleaned frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.calendar import day_index
from isotherm.operators import national, totals, year
from isotherm.operators.clean import clean, rule_audit
from isotherm.operators.normals import day_normals, normal_years
from isotherm.operators.series import years
from isotherm.schema import FULL_YEAR


def year_summary(obs: DataFrame, level="alle", jahr: int | None = None, nv: int = 1991) -> DataFrame:
    """One row per station: last day, running flag, rank to date, audit, the last day's normal."""
    c = clean(obs, level)
    head = year.ytd_rank(c, jahr)
    listed = years(c).groupBy("station").agg(
        F.sort_array(F.collect_list("jahr"), asc=False).alias("jahre"))
    last = c.select("station", F.col("datum").alias("letzter"), F.col("tmk").alias("tag_tmk"),
                    F.col("txk").alias("tag_txk"), F.col("tnk").alias("tag_tnk"))
    usual = day_normals(c, nv).select("station", "k", F.col("tmk").alias("normal_tmk"),
                                      "p10", "p90")
    return (
        head.join(last, ["station", "letzter"], "left")
        .withColumn("k", day_index(F.col("letzter")))
        .join(usual, ["station", "k"], "left").drop("k")
        .join(normal_years(c, nv), "station", "left")
        .join(listed, "station", "left")
        .join(rule_audit(obs, level).withColumnRenamed("tage", "rohe_tage"), "station", "left")
    )


def totals_summary(c: DataFrame, column: str = "rsk", jahr: int | None = None, nv: int = 1991,
                   min_days: int = FULL_YEAR) -> DataFrame:
    """Per station and year: totals with place and normal, and the curve's end beside the band.

    Place, normal and the end of the curve (the year's sum, on its last day with a value) all come from
    the yearly totals; the days are read for those, their dates, the dry spells and the band.
    """
    years = totals.placed(totals.totals_with_end(c, column), nv, min_days)
    some = F.col("tage") > 0
    wanted = F.lit(int(jahr)) if jahr is not None else F.max(F.when(some, F.col("jahr"))).over(Window.partitionBy("station"))
    shown = years.withColumn("_shown", some & (F.col("jahr") == wanted)).withColumns({
        "k": F.when(F.col("_shown"), day_index(F.col("ende"))),
        "stand": F.when(F.col("_shown"), F.col("summe"))}).drop("ende", "_shown")
    band = totals.cumulative_band(c, column, nv, min_days).select("station", "k", "p10", "p50", "p90")
    return shown.join(band, ["station", "k"], "left")


def failed_stations(failed: DataFrame, pattern: str = r"_(\d{5})_") -> DataFrame:
    """(station, fehler) of the files that failed; the station is read from the file's name."""
    number = F.regexp_extract("path", pattern, 1)
    return failed.select(F.when(number != "", number.try_cast("int")).alias("station"), "fehler")


def snapshot_job(c: DataFrame, st: DataFrame, failed: DataFrame, days: int = 7) -> dict[str, DataFrame]:
    """The national snapshot and the stations that could not be loaded for it."""
    return {"werte": national.national_snapshot(c, st, days), "fehler": failed_stations(failed)}


def records_job(c: DataFrame, st: DataFrame, days: int = 365, calendar_days: int = 14,
                min_years: int = 20, failed: DataFrame | None = None) -> dict[str, DataFrame]:
    """New records and calendar-day records of all stations, with the station's data; and the
    stations that failed, where the failed files are given."""
    names = st.select(F.col("id").alias("station"), "name", "land", "hoehe")
    placed = national.new_records(c, days).join(names, "station")
    by_day = national.calendar_day_records(c, calendar_days, min_years).join(names, "station")
    out = {
        "eintraege": placed.orderBy("datum", "kategorie", "platz", "name"),
        "kalendertag": by_day.orderBy("datum", "kategorie", "name"),
    }
    return out if failed is None else out | {"fehler": failed_stations(failed)}
