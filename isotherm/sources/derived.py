"""Observation, station, place and forecast tables derived from star-schema tables.

The rules are plain arithmetic on the given rows, so every derived table grows with its source
and carries every kind of implausible value the cleaning rules look for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _station_id():
    flag = F.when(F.col("l_returnflag") == "A", 10).when(
        F.col("l_returnflag") == "N", 20).otherwise(30)
    return flag + F.when(F.col("l_linestatus") == "F", 1).otherwise(2)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six series of station-days from ``lineitem``."""
    days = (
        table(spark, sf_dir, "lineitem")
        .groupBy(_station_id().alias("station"), F.to_date("l_shipdate").alias("datum"))
        .agg(F.avg("l_quantity").alias("q_avg"), F.max("l_quantity").alias("q_max"),
             F.min("l_quantity").alias("q_min"), F.max("l_extendedprice").alias("p_max"),
             F.avg("l_extendedprice").alias("p_avg"), F.min("l_discount").alias("d_min"),
             F.avg("l_tax").alias("t_avg"), F.min("l_linenumber").alias("ln_min"))
    )
    md = F.month("datum") * 100 + F.day("datum")
    return days.select(
        "station", "datum",
        (F.when(md == 518, F.col("q_max") + 1).otherwise(F.col("q_avg")) - 10).alias("tmk"),
        (F.when(md == 519, F.lit(71.0)).when(md == 517, F.col("q_min") - 1)
         .otherwise(F.col("q_max")) - 10).alias("txk"),
        (F.col("q_min") - 10).alias("tnk"),
        F.when(F.day("datum") % 10 == 0, 1).when(F.year("datum") < 1998, 5).otherwise(10)
        .alias("qn"),
        F.when(F.col("datum") <= F.lit("2000-12-31").cast("date"), 0).otherwise(1)
        .alias("quelle"),
        (F.col("p_max") / 2500 + F.when(md == 613, 60).otherwise(0)).alias("fx"),
        (F.col("p_avg") / 2500 + F.when(md == 614, 50).otherwise(0)).alias("fm"),
        (F.col("d_min") * 100).alias("rsk"), F.col("ln_min").alias("rskf"),
        (F.col("t_avg") * 210).alias("sdk"),
        F.floor(F.col("q_min") / 10).cast("double").alias("shk"),
        (F.col("d_min") * 90).alias("nm"), (F.col("q_avg") / 2).alias("vpm"),
        (F.col("q_avg") / 2 + 990).alias("pm"), (F.col("q_max") * 2.05).alias("upm"),
        (F.col("q_min") - 12).alias("tgk"),
        F.when(F.day("datum") % 7 == 0, 3).otherwise(10).alias("qn3"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per derived series."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(_station_id().alias("id"), flag, status)
        .agg(F.min(F.to_date("l_shipdate")).alias("von"),
             F.max(F.to_date("l_shipdate")).alias("bis"))
        .select(
            "id", F.concat(F.lit("Station "), flag, status).alias("name"), flag.alias("land"),
            F.when(status == "F", 300).otherwise(1600).alias("hoehe"),
            F.when(flag == "A", 48.0).when(flag == "N", 51.0).otherwise(53.5).alias("lat"),
            F.when(status == "F", 8.0).otherwise(12.0).alias("lon"), "von", "bis")
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and summits from ``customer``."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_name").alias("name"),
        (F.lit(47.5) + (key * 37 % 700) / 100.0).alias("lat"),
        (F.lit(6.5) + (key * 53 % 800) / 100.0).alias("lon"),
        (key * 7 % 2500).cast("int").alias("hoehe"),
        F.floor(F.abs("c_acctbal")).alias("einwohner"), (key % 9 == 0).alias("gipfel"))


def supplier_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A denser station network from ``supplier``, some closed, some short, some unplaced."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.cast("int").alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("Land "), F.col("s_nationkey")).alias("land"),
        (key * 13 % 2000).cast("int").alias("hoehe"),
        F.when(key % 17 != 0, F.lit(47.5) + (key * 29 % 700) / 100.0).alias("lat"),
        (F.lit(6.5) + (key * 61 % 800) / 100.0).alias("lon"),
        F.make_date((F.lit(1900) + key * 11 % 90).cast("int"), F.lit(1), F.lit(1)).alias("von"),
        F.make_date(F.when(key % 5 == 0, 1999).otherwise(2001), F.lit(11), F.lit(4))
        .alias("bis"))


SYMBOLS = ["klar", "heiter", "wolkig", "bedeckt", "nebel", "niesel", "regen", "starkregen",
           "schauer", "schneeregen", "schnee", "schneeschauer", "gewitter", "glatteis", "wind"]


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rows of five models from ``events``; several places by user."""
    names = F.array(*[F.lit(s) for s in SYMBOLS])
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return (
        table(spark, sf_dir, "events")
        .groupBy((F.col("user_id") % 3 + 1).cast("int").alias("ort"), F.col("event_type").alias("modell"), hour.alias("zeit"))
        .agg(F.avg("value").alias("v_avg"), F.max("value").alias("v_max"),
             F.min("value").alias("v_min"), F.max(F.col("user_id") % 15).alias("u_max"),
             F.count(F.lit(1)).alias("n"))
        .select(
            "ort", "modell", "zeit", (F.col("v_avg") / 10).alias("temp"),
            F.when(F.col("n") % 7 != 0, F.col("v_avg") % 100).alias("wolken"),
            (F.col("v_min") / 10).alias("regen"), (F.col("v_avg") / 5).alias("wind"),
            (F.col("v_max") / 4).alias("boe"),
            F.element_at(names, (F.col("u_max") + 1).cast("int")).alias("symbol"),
            F.when(F.col("u_max") % 3 == 0, F.lit(True)).when(
                F.col("u_max") % 3 == 1, F.lit(False)).alias("ist_tag"),
            F.when(F.col("n") % 4 != 0, F.col("v_max") % 101).alias("wkt"))
    )
