"""Records of a station and the same day in history."""

from __future__ import annotations

import datetime as dt
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.calendar import day_index, month_day
from isotherm.operators.common import last_days, with_first_dates
from isotherm.operators.normals import day_means
from isotherm.schema import CATEGORIES


def by_category(c: DataFrame) -> DataFrame:
    """One row per value and record category: station, datum, kat, key (smaller is better)."""
    entries = [
        F.struct(F.lit(i).alias("kat"),
                 (-F.col(col) if direction == "hoch" else F.col(col)).alias("key"))
        for i, col, direction, *_ in CATEGORIES
    ]
    return (
        c.select("station", "datum", F.explode(F.array(*entries)).alias("e"))
        .select("station", "datum", "e.kat", "e.key").where(F.col("key").isNotNull())
    )


def _per_category(index: int) -> Column:
    return F.element_at(F.array(*[F.lit(cat[index]) for cat in CATEGORIES]), F.col("kat") + 1)


def shown_value(key: Column) -> Column:
    """Back from the sort key to the value in display units."""
    sign = F.when(_per_category(2) == "hoch", -1.0).otherwise(1.0)
    return key * sign * _per_category(5)


def with_category(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "spalte": _per_category(1), "richtung": _per_category(2), "kategorie": _per_category(3),
        "einheit": _per_category(4)})


def permitted_depth(c: DataFrame) -> DataFrame:
    """How deep a series may be read: under 10 years 1, under 20 three, under 50 five, else 10."""
    years = (F.datediff(F.max("datum"), F.min("datum")) + 1) / 365.25
    n = (F.when(F.col("jahre") < 10, 1).when(F.col("jahre") < 20, 3)
         .when(F.col("jahre") < 50, 5).otherwise(10))
    return c.groupBy("station").agg(years.alias("jahre")).withColumn("erlaubt", n)


def bounds(c: DataFrame, n: int = 10) -> DataFrame:
    """Per station and category (key, monat): the n-th of the monthly bests, else NULL.

    Each monthly best is the value of a day in that month. A day with a worse key, or with the
    same key in a later month, comes after n such days and is none of the n best, however many
    days share a value. A hash aggregation of the days, then one row per month.
    """
    best = [F.min(-F.col(col) if direction == "hoch" else F.col(col)).alias(f"_{i}")
            for i, col, direction, *_ in CATEGORIES]
    months = c.groupBy("station", F.trunc("datum", "month").alias("_monat")).agg(*best)

    def nth(i):
        pair = F.when(F.col(f"_{i}").isNotNull(), F.struct(F.col(f"_{i}").alias("key"), F.col("_monat").alias("monat")))
        return F.get(F.sort_array(F.collect_list(pair)), F.lit(n - 1)).alias(f"_{i}")

    # plain columns: the test of the days stays short generated code
    return months.groupBy("station").agg(*[nth(i) for i, *_ in CATEGORIES]).select(
        "station", *[F.coalesce(F.col(f"_{i}.key"), F.lit(float("inf"))).alias(f"_g{i}") for i, *_ in CATEGORIES],
        *[F.col(f"_{i}.monat").alias(f"_m{i}") for i, *_ in CATEGORIES])


def promising(c: DataFrame, limits: DataFrame, history_until: Column | None = None) -> DataFrame:
    """Values by category that may be among the best.

    The days are tested before they are spread over the categories, so only the few that pass
    in some category are copied. With ``history_until`` the bounds are those of the days
    before it, and a later day only passes with a key better than the bound's.
    """
    columns = list(dict.fromkeys(cat[1] for cat in CATEGORIES))
    keys = [-F.col(col) if direction == "hoch" else F.col(col) for _, col, direction, *_ in CATEGORIES]
    days = c.select("station", "datum", *columns).join(limits, "station", "left")
    open_limit = [F.coalesce(F.col(f"_g{i}"), F.lit(float("inf"))) for i, *_ in CATEGORIES]
    near = days.where(reduce(operator.or_, [key <= g for key, g in zip(keys, open_limit)]))
    entries = [F.struct(F.lit(i).alias("kat"), key.alias("key"), g.alias("_g"), F.col(f"_m{i}").alias("_m"))
               for i, (key, g) in enumerate(zip(keys, open_limit))]
    tied = F.trunc("datum", "month") <= F.col("_m")
    if history_until is not None:
        tied = tied & (F.col("datum") < history_until)
    return (
        near.select("station", "datum", F.inline(F.array(*entries)))
        .where((F.col("key") < F.col("_g")) | ((F.col("key") == F.col("_g")) & tied))
        .drop("_g", "_m")
    )


def best_days(values: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` days of every category, earlier days first among equals.

    The row number is filtered directly above its window, so that every task cuts its own
    rows to ``n`` per (station, category) before the shuffle.
    """
    order = Window.partitionBy("station", "kat").orderBy("key", "datum")
    return values.withColumn("_nr", F.row_number().over(order)).where(F.col("_nr") <= n)


def records(c: DataFrame, n: int = 10, limit_depth: bool = False) -> DataFrame:
    """The best ``n`` days of every category; equal values share the place of the first."""
    group = Window.partitionBy("station", "kat")
    best = best_days(promising(c, bounds(c, n)), n).withColumn(
        "platz", F.rank().over(group.orderBy("key")))
    # days with a value: one count per column, not one per exploded row
    columns = sorted({cat[1] for cat in CATEGORIES})
    counts = c.groupBy("station").agg(*[F.count(x).alias(x) for x in columns]).select(
        "station", F.create_map(*[p for x in columns for p in (F.lit(x), F.col(x))]).alias("_n"))
    out = with_category(best).join(counts, "station").select(
        "station", "spalte", "richtung", "kategorie", "einheit", "platz", "datum",
        shown_value(F.col("key")).alias("wert"),
        F.element_at("_n", F.col("spalte")).alias("tage"))
    if limit_depth:
        out = out.join(permitted_depth(c).select("station", "erlaubt"), "station").where(
            F.col("platz") <= F.col("erlaubt"))
    return out


def extremes(c: DataFrame) -> DataFrame:
    """Hottest maximum and coldest minimum with their first dates."""
    best = c.groupBy("station").agg(F.max("txk").alias("heiss"), F.min("tnk").alias("kalt"))
    return with_first_dates(best, c, {"station": F.col("station")}, {
        "heiss_datum": ("txk", "heiss"), "kalt_datum": ("tnk", "kalt"),
    }).select("station", "heiss", "heiss_datum", "kalt", "kalt_datum")


HISTORY = ("tmk", "txk", "tnk")


def _same_day(c: DataFrame, date: dt.date | None) -> DataFrame:
    """Values of the month-day in all years: station, ziel, jahr, spalte, wert, gewertet ranks."""
    if date is None:
        rows = c.join(last_days(c).select("station", F.col("letzter").alias("ziel")), "station")
        rows = rows.where(month_day(F.col("datum")) == month_day(F.col("ziel")))
    else:
        rows = (
            c.join(last_days(c).select("station"), "station", "left_semi")
            .where((F.month("datum") == date.month) & (F.day("datum") == date.day))
            .withColumn("ziel", F.lit(date)))
    entries = F.array(*[F.struct(F.lit(s).alias("spalte"), F.col(s).alias("wert"))
                        for s in HISTORY])
    return (
        rows.select("station", "ziel", F.year("datum").alias("jahr"), F.inline(entries))
        .where(F.col("wert").isNotNull())
    )


def on_this_day(c: DataFrame, date: dt.date | None = None, nv: int = 1991) -> DataFrame:
    """Own value, warm and cold place, number of years, the three warmest and coldest, normal."""
    rows = _same_day(c, date)
    group = Window.partitionBy("station", "spalte")
    ranked = rows.withColumns({
        "_warm": F.row_number().over(group.orderBy(F.desc("wert"), "jahr")),
        "_kalt": F.row_number().over(group.orderBy("wert", "jahr")),
        "_platz_warm": F.rank().over(group.orderBy(F.desc("wert"))),
        "_platz_kalt": F.rank().over(group.orderBy("wert")),
    })
    own = F.col("jahr") == F.year("ziel")

    def nth(order, i, what):
        return F.max(F.when(F.col(order) == i, F.col(what)))

    out = ranked.groupBy("station", "ziel", "spalte").agg(
        F.max(F.when(own, F.col("wert"))).alias("wert"),
        F.max(F.when(own, F.col("_platz_warm"))).alias("platz_warm"),
        F.max(F.when(own, F.col("_platz_kalt"))).alias("platz_kalt"),
        F.count(F.lit(1)).alias("von"),
        *[nth(f"_{side}", i, what).alias(f"{side}{i}_{what}")
          for side in ("warm", "kalt") for i in (1, 2, 3) for what in ("wert", "jahr")])
    usual = day_means(c, list(HISTORY), nv).select("station", "k", F.inline(F.array(*[
        F.struct(F.lit(s).alias("spalte"), F.col(s).alias("normal")) for s in HISTORY])))
    return (
        out.withColumn("k", day_index(F.col("ziel")))
        .join(usual, ["station", "spalte", "k"], "left").drop("k")
        .withColumnRenamed("ziel", "datum")
    )


def this_day_years(c: DataFrame, date: dt.date | None = None) -> DataFrame:
    """All years of the month-day, newest first: tmk, txk, tnk side by side."""
    return (
        _same_day(c, date).groupBy("station", "jahr")
        .agg(*[F.max(F.when(F.col("spalte") == s, F.col("wert"))).alias(s) for s in HISTORY])
    )
