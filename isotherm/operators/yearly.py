"""Statistics per year: threshold days, stripes, snow, wind, frost."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from isotherm.functions.calendar import winter_year
from isotherm.operators.common import in_period, with_first_dates
from isotherm.operators.series import yearly_means
from isotherm.schema import COVERAGE, FULL_YEAR, HURRICANE, KMH, SNOW, STORM, THRESHOLDS

TEST = {">=": operator.ge, "<": operator.lt}


def _station() -> WindowSpec:
    """Over one row per year."""
    return Window.partitionBy("station")


def _usual(value: str, counted: Column) -> Column:
    """Mean over the years of the station that count."""
    return F.avg(F.when(counted, F.col(value))).over(_station())


def threshold_days(c: DataFrame, nv: int = 1991, min_days: int = FULL_YEAR) -> DataFrame:
    """Days per year beyond each threshold, days measured, and the normal of each kind."""
    kinds = {name: F.count_if(TEST[op](F.col(col), limit))
             for name, (col, op, limit) in THRESHOLDS.items()}
    measured = {"txk": "tage_x", "tnk": "tage_n", "tgk": "tage_g"}
    rows = c.groupBy("station", F.year("datum").alias("jahr")).agg(
        *[agg.alias(name) for name, agg in kinds.items()],
        *[F.count(col).alias(name) for col, name in measured.items()])
    return rows.withColumns({
        f"normal_{name}": _usual(
            name, in_period(nv) & (F.col(measured[THRESHOLDS[name][0]]) >= min_days))
        for name in THRESHOLDS})


def stripes(c: DataFrame, nv: int = 1991, min_days: int = FULL_YEAR) -> DataFrame:
    """Yearly means and their deviation from the mean of the period's years."""
    rows = yearly_means(c, "tmk", min_days)
    return rows.withColumns({
        "bezug": _usual("m", in_period(nv)),
        "bezug_jahre": F.count(F.when(in_period(nv), 1)).over(_station()),
    }).select("station", "jahr", "m", (F.col("m") - F.col("bezug")).alias("abw"), "bezug",
              "bezug_jahre")


def snow_winters(c: DataFrame, nv: int = 1991, share: float = COVERAGE) -> DataFrame:
    """October to April, named by January."""
    snow = F.col("shk") >= SNOW
    cold = c.where(~F.month("datum").between(5, 9))
    keys = {"station": F.col("station"), "winter": winter_year(F.col("datum"))}
    rows = with_first_dates(
        cold.groupBy(*[e.alias(k) for k, e in keys.items()])
        .agg(F.count("shk").alias("tage"), F.count_if(snow).alias("schneetage"), F.max("shk").alias("max"),
             F.min(F.when(snow, F.col("datum"))).alias("erster"),
             F.max(F.when(snow, F.col("datum"))).alias("letzter")),
        cold, keys, {"max_datum": ("shk", "max")})
    counted = in_period(nv, "winter") & (F.col("tage") >= 212 * share)
    return rows.select("station", "winter", "tage", "schneetage", "max", "max_datum", "erster", "letzter",
                       _usual("schneetage", counted).alias("normal"))


def wind_years(c: DataFrame, nv: int = 1991, min_days: int = FULL_YEAR) -> DataFrame:
    """Storm days and strongest gust (km/h); years with few days are marked."""
    rows = c.groupBy("station", F.year("datum").alias("jahr")).agg(
        F.count("fx").alias("tage"), F.count_if(F.col("fx") >= STORM).alias("sturm"),
        F.count_if(F.col("fx") >= HURRICANE).alias("orkan"), F.max("fx").alias("max"))
    rows = with_first_dates(rows, c, {"station": F.col("station"), "jahr": F.year("datum")},
                            {"max_datum": ("fx", "max")})
    counted = in_period(nv) & (F.col("tage") >= min_days)
    return rows.select("station", "jahr", "tage", "sturm", "orkan",
                       (F.col("max") * KMH).alias("max"), "max_datum",
                       (F.col("tage") < min_days).alias("unvollstaendig"),
                       _usual("sturm", counted).alias("normal"))


def frost_years(c: DataFrame, nv: int = 1991, min_days: int = FULL_YEAR) -> DataFrame:
    """Last frost before and first frost from 1 July, in the air and on the ground."""
    first_half = F.month("datum") <= 6
    aggregates = []
    for name, col in (("luft", "tnk"), ("boden", "tgk")):
        frost = F.col(col) < 0
        aggregates += [
            F.max(F.when(frost & first_half, F.col("datum"))).alias(f"{name}_letzter"),
            F.min(F.when(frost & ~first_half, F.col("datum"))).alias(f"{name}_erster"),
            F.count(col).alias(f"{name}_tage")]
    rows = c.groupBy("station", F.year("datum").alias("jahr")).agg(*aggregates)
    rows = rows.where((F.col("luft_tage") > 0) | (F.col("boden_tage") > 0))
    rows = rows.withColumns({
        f"{n}_frei": F.datediff(f"{n}_erster", f"{n}_letzter") - 1 for n in ("luft", "boden")})
    return rows.withColumns({
        f"normal_{n}_frei": _usual(
            f"{n}_frei", in_period(nv) & (F.col(f"{n}_tage") >= min_days))
        for n in ("luft", "boden")})
