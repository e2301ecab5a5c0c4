"""Heat and cold waves, and dry spells: runs of consecutive days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.calendar import day_index, year_end
from isotherm.operators.common import runs, with_value
from isotherm.operators.normals import day_normal
from isotherm.schema import WET


def waves(c: DataFrame, kind: str = "normal", hot: float = 30.0, cold: float = 0.0,
          min_days: int = 3, nv: int = 1991) -> DataFrame:
    """Every wave with start, end, days, extreme and mean.

    ``fest``: three days with maximum >= 30 or < 0. ``eigen``: thresholds and length given.
    ``normal``: five days with the mean above the 90 % or below the 10 % value of the
    calendar day's normal.
    """
    if kind == "normal":
        # a station's limits as arrays (366 entries at most): days meet them by station alone, and a hash
        # join leaves them unsorted. No lambda here: it would end code generation, and each day would
        # be written out with its station's arrays
        usual = day_normal(c, "tmk", nv).groupBy("station").agg(
            F.sort_array(F.collect_list(F.struct("k", "p10", "p90"))).alias("_l")).select(
            "station", F.col("_l.k").alias("_k"), F.col("_l.p10").alias("_low"), F.col("_l.p90").alias("_high"))
        k = day_index(F.col("datum"))
        at = F.when(F.size("_k") == 366, k).otherwise((F.array_position("_k", k) - 1).cast("int"))
        sort = F.when(F.col("tmk") > F.get("_high", at), "hitze").when(F.col("tmk") < F.get("_low", at), "kaelte")
        marked = (
            with_value(c, "tmk").select("station", "datum", "tmk").join(usual.hint("shuffle_hash"), "station")
            .select("station", "datum", "tmk", sort.alias("typ")).where(F.col("typ").isNotNull())
        )
        value, shortest = "tmk", 5
    else:
        if kind == "fest":
            hot, cold, min_days = 30.0, 0.0, 3
        rows, value, shortest = with_value(c, "txk"), "txk", max(1, int(min_days))
        is_hot, is_cold = F.col("txk") >= float(hot), F.col("txk") < float(cold)
        # a day once per sort that holds (own thresholds may overlap); both are formed in one pass
        sorts = F.array_compact(F.array(F.when(is_hot, F.lit("hitze")), F.when(is_cold, F.lit("kaelte"))))
        marked = rows.withColumn("typ", F.explode(sorts))
    found = runs(marked, value, ["typ"])
    return found.where(F.col("tage") >= shortest).select(
        "station", "typ", "von", "bis", "tage",
        F.when(F.col("typ") == "hitze", F.col("hoch")).otherwise(F.col("tief")).alias("extrem"),
        (F.col("summe") / F.col("tage")).alias("mittel"))


def wave_years(found: DataFrame) -> DataFrame:
    """Number, days and longest wave per start year and type."""
    aggregates = []
    for t in ("hitze", "kaelte"):
        days = F.when(F.col("typ") == t, F.col("tage"))
        aggregates += [F.count(days).alias(t),
                       F.coalesce(F.sum(days), F.lit(0)).alias(f"{t}_tage"),
                       F.coalesce(F.max(days), F.lit(0)).alias(f"{t}_laengste")]
    return found.groupBy("station", F.year("von").alias("jahr")).agg(*aggregates)


def longest_waves(found: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("station", "typ").orderBy(F.desc("tage"), "von")
    return found.withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= n)


def longest_dry(c: DataFrame) -> DataFrame:
    """Of the years that a dry run reaches: ``trocken``, the longest one there, and its start.

    Length and start make one number, larger for longer and then for earlier runs: a hash
    aggregate of fixed width, where a minimum of pairs would be sorted.
    """
    dry = runs(with_value(c, "rsk").where(F.col("rsk") < WET), "rsk")
    years = F.explode(F.sequence(F.year("von"), F.year("bis")))
    reached = dry.select("station", "von", "bis", years.alias("jahr")).withColumn(
        "laenge", F.datediff(F.least("bis", year_end(F.col("jahr"))), "von") + 1)
    first = F.col("laenge").cast("bigint") * 10_000_000 - F.unix_date("von")
    return reached.groupBy("station", "jahr").agg(
        F.max("laenge").alias("trocken"), F.max_by("von", first).alias("trocken_von"))


def dry_spells(c: DataFrame) -> DataFrame:
    """Per year the longest dry run reached in it, counted from its start in whatever year.

    A run of several years counts in each with the length it had reached there.
    """
    measured = c.select("station", F.year("datum").alias("jahr")).distinct()
    return measured.join(longest_dry(c), ["station", "jahr"], "left").select(
        "station", "jahr", F.coalesce("trocken", F.lit(0)).alias("trocken"), "trocken_von")
