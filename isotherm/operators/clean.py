"""Cleaning on read: quality level, physical limits, contradictions, jumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.operators.common import with_previous_day
from isotherm.schema import (
    JUMP, LIMITS, PRECIPITATION_FORMS, TEMPERATURE_LIMITS, quality_level,
)

TEMPERATURES = ("tmk", "txk", "tnk")


def _inside(value: Column, limits: tuple[float, float]) -> Column:
    return F.when(value.between(*limits), value)


def _passed(level, column: str = "qn") -> Column:
    return F.coalesce(F.col(column), F.lit(0)) >= quality_level(level)


def clean(obs: DataFrame, level="alle") -> DataFrame:
    """Same columns as the observations (without ``qn3``), implausible values NULL.

    Two projections and nothing else: filters and column pruning pass through to the scan.
    """
    good, good_wind = _passed(level), _passed(level, "qn3")
    limited = {
        m: F.when(good, _inside(F.col(m), TEMPERATURE_LIMITS)) for m in TEMPERATURES
    } | {
        m: F.when(good_wind if m in ("fx", "fm") else good, _inside(F.col(m), bounds))
        for m, bounds in LIMITS.items()
    } | {"rskf": F.when(good & F.col("rskf").isin(PRECIPITATION_FORMS), F.col("rskf"))}
    crossed = F.coalesce(F.col("txk") < F.col("tnk"), F.lit(False))
    outside = F.coalesce(
        (F.col("tmk") < F.col("tnk")) | (F.col("tmk") > F.col("txk")), F.lit(False))
    calm_gust = F.coalesce(F.col("fm") > F.col("fx"), F.lit(False))
    return obs.withColumns(limited).withColumns({
        "tmk": F.when(~crossed & ~outside, F.col("tmk")),
        "txk": F.when(~crossed, F.col("txk")),
        "tnk": F.when(~crossed, F.col("tnk")),
        "fm": F.when(~calm_gust, F.col("fm")),
    }).drop("qn3")


def jumps(c: DataFrame, column: str = "tmk", threshold: float = JUMP) -> DataFrame:
    """Days whose value lies more than the threshold from the day before; nothing is removed."""
    return (
        with_previous_day(c.select("station", "datum", column), column)
        .where(F.abs(F.col(column) - F.col("vorher")) > threshold)
        .select("station", "datum", F.col(column).alias("wert"), "vorher")
    )


def rule_audit(obs: DataFrame, level="alle") -> DataFrame:
    """Per station what every rule takes away or marks."""
    good = _passed(level)
    lim = {m: _inside(F.col(m), TEMPERATURE_LIMITS) for m in TEMPERATURES}
    crossed = F.coalesce(lim["txk"] < lim["tnk"], F.lit(False))
    outside = F.coalesce((lim["tmk"] < lim["tnk"]) | (lim["tmk"] > lim["txk"]), F.lit(False))
    lost = sum((F.when(good & F.col(m).isNotNull() & lim[m].isNull(), 1).otherwise(0)
                for m in TEMPERATURES), F.lit(0))
    counts = obs.groupBy("station").agg(
        F.count(F.lit(1)).alias("tage"),
        F.count_if(~good).alias("qn_weg"),
        F.sum(lost).alias("grenze_weg"),
        F.count_if(good & crossed).alias("max_unter_min"),
        F.count_if(good & ~crossed & outside).alias("mittel_ausserhalb"),
    )
    marked = jumps(clean(obs, level)).groupBy("station").agg(
        F.count(F.lit(1)).alias("spruenge"))
    return counts.join(marked, "station", "left").withColumn(
        "spruenge", F.coalesce("spruenge", F.lit(0)))
