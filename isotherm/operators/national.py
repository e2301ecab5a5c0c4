"""All stations at once: snapshot, top lists, new records."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.calendar import day_index, month_day
from isotherm.functions.numbers import displayed
from isotherm.operators.records import (
    best_days, bounds, by_category, promising, shown_value, with_category,
)
from isotherm.schema import CATEGORIES, CATEGORY_ORDER, SNAPSHOT

# ---- fixed values: display factor and digits of the snapshot's measures ------
SHOWN = {
    "txk": (1.0, 1), "tmk": (1.0, 1), "tnk": (1.0, 1), "tgk": (1.0, 1), "rsk": (1.0, 1),
    "sdk": (1.0, 1), "shk": (1.0, 0), "fx": (3.6, 0), "fm": (3.6, 0), "nm": (1.0, 1),
    "upm": (1.0, 0), "pm": (1.0, 1), "vpm": (1.0, 1),
}
HEIGHT_STEPS = [500, 1000, 1500, 2000]
RECORD_DEPTH = 10
# ------------------------------------------------------------------------------


def newest_day(c: DataFrame) -> Column:
    """The newest day of all stations, as a scalar subquery."""
    return c.agg(F.max("datum")).scalar()


def national_snapshot(c: DataFrame, st: DataFrame, days: int = 7) -> DataFrame:
    """The last days of every station with a row among them, one row per day and measure."""
    stand = newest_day(c)
    recent = c.where(F.col("datum") >= F.date_sub(stand, days - 1))
    calendar = F.explode(F.sequence(F.date_sub(stand, days - 1), stand)).alias("datum")
    grid = recent.select("station").distinct().select("station", calendar)
    entries = F.array(*[F.struct(F.lit(m).alias("spalte"), displayed(F.col(m)).alias("wert"))
                        for m in SNAPSHOT])
    return (
        grid.join(recent.select("station", "datum", *SNAPSHOT), ["station", "datum"], "left")
        .select("station", "datum", F.inline(entries))
        .join(st.select(F.col("id").alias("station"), "name", "land", "hoehe"), "station", "left")
    )


def _height(height: str) -> Column:
    """``alle``, ``u500`` (below), ``a500`` (from), ... up to 2000; anything else means all."""
    if height[:1] in ("u", "a") and height[1:].isdigit() and int(height[1:]) in HEIGHT_STEPS:
        m = int(height[1:])
        return F.col("hoehe") < m if height[0] == "u" else F.col("hoehe") >= m
    return F.lit(True)


def _shown(value: Column) -> Column:
    """Display value of a measure, a half always upwards."""
    out = None
    for m, (factor, digits) in SHOWN.items():
        v = F.floor(value * factor * 10 ** digits + 0.5) / 10 ** digits
        out = F.when(F.col("spalte") == m, v) if out is None else out.when(F.col("spalte") == m, v)
    return out


def top_stations(snapshot: DataFrame, day: dt.date | None = None, column: str | None = None,
                 direction: str = "hoch", height: str = "alle", n: int = 50) -> DataFrame:
    """The first ``n`` stations of a day and measure (of each day and measure where not given).

    The displayed value decides, then the name in German order; equal values share a place.
    """
    rows = snapshot.where(F.col("wert").isNotNull() & _height(height))
    if day is not None:
        rows = rows.where(F.col("datum") == F.lit(day))
    if column is not None:
        rows = rows.where(F.col("spalte") == column)
    rows = rows.withColumn("wert", _shown(F.col("wert")))
    order = F.col("wert") if direction == "tief" else -F.col("wert")
    group = Window.partitionBy("datum", "spalte")
    return (
        rows.withColumn("_nr", F.row_number().over(
            group.orderBy(order, F.collate("name", "de"), "station")))
        .where(F.col("_nr") <= n)
        .withColumn("platz", F.rank().over(group.orderBy(order)))
        .select("datum", "spalte", "platz", "station", "name", "land", "hoehe", "wert")
    )


def station_count(snapshot: DataFrame, day: dt.date | None = None, column: str | None = None,
                  height: str = "alle") -> DataFrame:
    rows = snapshot
    if day is not None:
        rows = rows.where(F.col("datum") == F.lit(day))
    if column is not None:
        rows = rows.where(F.col("spalte") == column)
    return rows.groupBy("datum", "spalte").agg(
        F.count_if(F.col("wert").isNotNull() & _height(height)).alias("anzahl"))


def _permitted(years: Column) -> Column:
    """Places a series of this length gives away; 0 means none."""
    return (F.when(years < 3, 0).when(years < 20, 1).when(years < 30, 3)
            .when(years < 50, 5).otherwise(RECORD_DEPTH))


def new_records(c: DataFrame, days: int = 365) -> DataFrame:
    """Days of the last year whose value reached a permitted place when it was measured.

    A day can only reach place 10 if fewer than ten days before the window are at least as
    good, and only such days count for one another. So the best ten before the window and the
    few days that pass them are all that is compared: at most 10 + ``days`` values of a
    (station, category), held in one array and never paired into rows.
    """
    stand = newest_day(c)
    since = F.date_sub(stand, days - 1)
    # a day of the window no better than the bound of the history has ten days before it that
    # are as good: it neither places nor counts for another
    values = promising(c, bounds(c.where(F.col("datum") < since), RECORD_DEPTH), since)
    best = (
        best_days(values.where(F.col("datum") < since), RECORD_DEPTH)
        .groupBy("station", "kat")
        .agg(F.collect_list(F.struct("key", "datum")).alias("_alt"))
    )
    columns = list(dict.fromkeys(cat[1] for cat in CATEGORIES))
    firsts = c.groupBy("station").agg(
        *[F.min(F.when(F.col(x).isNotNull(), F.col("datum"))).alias(x) for x in columns])
    firsts = firsts.select("station", F.posexplode(F.array(*[F.col(cat[1]) for cat in CATEGORIES])).alias("kat", "_erster"))
    return _placed(values.where(F.col("datum") >= since), best, firsts)


def _placed(window: DataFrame, best: DataFrame, firsts: DataFrame) -> DataFrame:
    """Places of the window's values (station, datum, kat, key) behind the ten best before it (_alt) and behind one another."""
    none = F.array().cast("array<struct<key:double,datum:date>>")
    passing = (
        window.join(best, ["station", "kat"], "left")
        .withColumn("_alt", F.coalesce("_alt", none))
        .withColumn("_davor", F.size(F.filter("_alt", lambda a: a["key"] <= F.col("key"))))
        .where(F.col("_davor") < RECORD_DEPTH)
        .groupBy("station", "kat")
        .agg(F.first("_alt").alias("_alt"),
             F.collect_list(F.struct("datum", "key", "_davor")).alias("_neu"))
    )

    def placed(x):
        earlier = F.filter("_neu", lambda y: y["datum"] < x["datum"])
        as_good = F.filter(earlier, lambda y: y["key"] <= x["key"])
        before = F.concat("_alt", F.transform(
            earlier, lambda y: F.struct(y["key"].alias("key"), y["datum"].alias("datum"))))
        return F.struct(
            x["datum"].alias("datum"), x["key"].alias("key"),
            (x["_davor"] + F.size(as_good) + 1).alias("platz"),
            F.array_min(before).alias("_bisher"))

    years = (F.datediff("datum", "_erster") + 1) / 365.25
    return with_category(
        passing.select("station", "kat", F.inline(F.transform("_neu", placed)))
        .join(firsts, ["station", "kat"])
        .withColumn("jahre", years).withColumn("von", _permitted(F.col("jahre")))
        .where(F.col("platz") <= F.col("von"))
    ).select(
        "station", "datum", "spalte", "richtung", "kategorie", "einheit",
        shown_value(F.col("key")).alias("wert"), "platz", "von", F.year("_erster").alias("seit"),
        "jahre", shown_value(F.col("_bisher.key")).alias("bisher_wert"),
        F.col("_bisher.datum").alias("bisher_datum"))


# ---- the ten best as a state that takes up new days -----------------------------
def _arrays(values: DataFrame) -> DataFrame:
    """(station, kat, beste, erster): at most ten (key, datum), best first, and the first day with a value."""
    firsts = values.groupBy("station", "kat").agg(F.min("datum").alias("erster"))
    best = best_days(values, RECORD_DEPTH).groupBy("station", "kat").agg(
        F.sort_array(F.collect_list(F.struct("key", "datum"))).alias("beste"))
    return best.join(firsts, ["station", "kat"])


def best_state(c: DataFrame, until: dt.date) -> DataFrame:
    """Per station and category the ten best days up to ``until`` and the first day: station, kat, beste, erster, bis.

    The days are read once for the bounds, once for what passes them and once for the first days.
    """
    old = c.where(F.col("datum") <= F.lit(until))
    best = best_days(promising(old, bounds(old, RECORD_DEPTH)), RECORD_DEPTH).groupBy("station", "kat").agg(
        F.sort_array(F.collect_list(F.struct("key", "datum"))).alias("beste"))
    columns = list(dict.fromkeys(cat[1] for cat in CATEGORIES))
    firsts = old.groupBy("station").agg(*[F.min(F.when(F.col(x).isNotNull(), F.col("datum"))).alias(x) for x in columns])
    firsts = firsts.select("station", F.posexplode(F.array(*[F.col(cat[1]) for cat in CATEGORIES])).alias("kat", "erster"))
    return best.join(firsts, ["station", "kat"]).withColumn("bis", F.lit(until))


def advance_state(state: DataFrame, c: DataFrame, until: dt.date) -> DataFrame:
    """The state up to ``until``: days after the state's own end come in. A day later than the state's end counts after those it holds.

    A state is merged, never recomputed; what it reads of the days is what lies behind its end.
    """
    since = state.agg(F.min("bis")).first()[0]
    if since is None:
        return best_state(c, until)
    new = _arrays(by_category(c.where((F.col("datum") > F.lit(since)) & (F.col("datum") <= F.lit(until)))))
    none = F.array().cast("array<struct<key:double,datum:date>>")
    old = state.select("station", "kat", F.col("beste").alias("_b"), F.col("erster").alias("_e"))
    return old.join(new, ["station", "kat"], "full").select(
        "station", "kat",
        F.slice(F.sort_array(F.concat(F.coalesce("_b", none), F.coalesce("beste", none))), 1, RECORD_DEPTH).alias("beste"),
        F.least("_e", "erster").alias("erster"), F.lit(until).alias("bis"))


def new_records_from_state(state: DataFrame, c: DataFrame, days: int = 365) -> DataFrame:
    """new_records (D4) from a state that ends before the window: only days behind its end are read.

    The newest day is looked up first; it and the window's first day are plain dates in the
    plan, so that they reach the scan. Raw days of the history are neither read nor shuffled.
    """
    bis = state.agg(F.min("bis")).first()[0]
    recent = c if bis is None else c.where(F.col("datum") > F.lit(bis))
    stand = recent.agg(F.max("datum")).first()[0]
    if stand is None:
        stand = bis or dt.date(1900, 1, 1) + dt.timedelta(days=days)
    since = stand - dt.timedelta(days=days - 1)
    if bis is not None and bis >= since:
        raise ValueError(f"the state ends on {bis}, after the window begins on {since}")
    before = advance_state(state, c, since - dt.timedelta(days=1)).withColumn("_n", F.size("beste"))
    values = by_category(recent.where(F.col("datum") >= F.lit(since)))
    best = before.select("station", "kat", F.col("beste").alias("_alt"), F.when(
        F.col("_n") >= RECORD_DEPTH, F.element_at("beste", -1)["key"]).alias("_letzter"))
    # no better than the tenth: ten days before it are as good
    near = values.join(best, ["station", "kat"], "left").where(F.col("_letzter").isNull() | (F.col("key") < F.col("_letzter")))
    firsts = before.select("station", "kat", "erster").unionByName(
        values.groupBy("station", "kat").agg(F.min("datum").alias("erster"))).groupBy("station", "kat").agg(F.min("erster").alias("_erster"))
    return _placed(near.select("station", "datum", "kat", "key"), best.select("station", "kat", "_alt"), firsts)


def calendar_day_records(c: DataFrame, days: int = 14, min_years: int = 20) -> DataFrame:
    """Days strictly better than every earlier value of the same month and day.

    Earlier days of the window count as well, so it may be longer than a year. A group of the
    window function is one month-day of a station: as many rows as the series has years.
    """
    stand = newest_day(c)
    since = F.date_sub(stand, days - 1)
    # the window's month-days, one spare for a skipped 29 February: 25 of 26 rows stay out
    back = F.pmod(day_index(stand) - day_index(F.col("datum")), F.lit(366))
    values = by_category(c.where(back <= days)).withColumn("md", month_day(F.col("datum")))
    before = Window.partitionBy("station", "kat", "md").orderBy("datum").rowsBetween(
        Window.unboundedPreceding, -1)
    seen = values.withColumns({
        "jahre": F.count(F.lit(1)).over(before),
        "_b": F.min(F.struct("key", "datum")).over(before)})
    return with_category(
        seen.where((F.col("datum") >= since) & (F.col("jahre") >= min_years)
                   & (F.col("key") < F.col("_b.key")))
    ).select(
        "station", "datum", "spalte", "richtung", "kategorie", "einheit",
        shown_value(F.col("key")).alias("wert"), "jahre",
        shown_value(F.col("_b.key")).alias("bisher_wert"),
        F.col("_b.datum").alias("bisher_datum"))


def records_by_day(rec: DataFrame) -> DataFrame:
    """Newest day first, categories in their fixed order, then place and value."""
    order = F.array_position(F.array(*[F.lit(k) for k in CATEGORY_ORDER]), F.col("kategorie"))
    value = F.when(F.col("richtung") == "hoch", -F.col("wert")).otherwise(F.col("wert"))
    return rec.orderBy(F.desc("datum"), F.when(order == 0, 99).otherwise(order), "platz", value,
                       "station")


def recent_records(rec: DataFrame, stand: dt.date | Column, days: int = 7) -> DataFrame:
    stand = stand if isinstance(stand, Column) else F.lit(stand)
    return rec.where(F.col("datum") >= F.date_sub(stand, days - 1)).orderBy(
        F.desc("datum"), "platz", "kategorie", "station")


def favourite_alerts(rec: DataFrame, cal: DataFrame, favourites: DataFrame,
                     since: dt.date | Column | None = None,
                     stand: dt.date | Column | None = None) -> DataFrame:
    """Records up to place 3 and calendar-day records of chosen stations since the last report;
    the first time the last three days."""
    if since is None:
        since = F.date_sub(stand if isinstance(stand, Column) else F.lit(stand), 3)
    since = since if isinstance(since, Column) else F.lit(since)
    shared = ["station", "datum", "kategorie", "einheit", "wert"]
    placed = rec.where((F.col("datum") > since) & (F.col("platz") <= 3)).select(
        *shared, F.lit("rekord").alias("art"), "platz", "seit",
        F.lit(None).cast("bigint").alias("jahre"))
    days = cal.where(F.col("datum") > since).select(
        *shared, F.lit("kalendertag").alias("art"), F.lit(None).cast("int").alias("platz"),
        F.lit(None).cast("int").alias("seit"), F.col("jahre").cast("bigint").alias("jahre"))
    return placed.unionByName(days).join(
        favourites.select("station").distinct(), "station", "left_semi")
