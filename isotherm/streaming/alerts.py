"""Severe-weather alerts on arriving forecast hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.operators.forecast import HEAVY_RAIN, STORM_KMH, alert_kinds, local_day


def stream_alerts(hours: DataFrame, delay: str = "36 hours", storm: float = STORM_KMH,
                  heavy: float = HEAVY_RAIN) -> DataFrame:
    """Every (ort, art, local day) once; hours later than the watermark are dropped.

    The delay is longer than a day, so that the key of a local day stays in the state for the
    whole day. Emits the first hour that arrives over a threshold, not the strongest.
    """
    kinds = F.array(*[F.struct(F.lit(art).alias("art"), condition.alias("da"))
                      for art, condition, _ in alert_kinds(hours, storm, heavy)])
    return (
        hours.withWatermark("zeit", delay)
        .select("ort", "zeit", F.explode(F.filter(kinds, lambda k: k["da"])).alias("_k"))
        .select("ort", "zeit", F.col("_k.art").alias("art"), local_day(F.col("zeit")).alias("tag"))
        .dropDuplicatesWithinWatermark(["ort", "art", "tag"])
    )
