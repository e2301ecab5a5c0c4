"""Hourly forecasts: blending, daily values, day parts, warnings.

Rows: ort, modell, zeit (UTC timestamp), temp, wolken, regen, wind, boe, symbol, ist_tag, wkt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.symbols import DRY_SYMBOLS, WET_SYMBOLS
from isotherm.operators.common import with_neighbours

# ---- fixed values -------------------------------------------------------------
ZONE = "Europe/Berlin"
# (id, name, description, source, id in the combined answer)
MODELS = [
    ("icon_d2", "ICON-D2", "DWD, 2 km, rund 2 Tage", "open-meteo", "icon_d2"),
    ("icon_eu", "ICON-EU", "DWD, 7 km", "open-meteo", "icon_eu"),
    ("knmi", "Harmonie KNMI", "Niederländischer Wetterdienst, 2 km, rund 2½ Tage", "open-meteo", "knmi_harmonie_arome_europe"),
    ("dmi", "Harmonie DMI", "Dänischer Wetterdienst, 2 km, rund 2½ Tage", "open-meteo", "dmi_harmonie_arome_europe"),
    ("arome", "AROME", "Météo-France, 2,5 km, rund 2 Tage", "open-meteo", "meteofrance_arome_france"),
    ("arpege", "ARPEGE", "Météo-France Europa, 10 km", "open-meteo", "meteofrance_arpege_europe"),
    ("ecmwf", "ECMWF IFS", "Europäisches Zentrum, 25 km", "open-meteo", "ecmwf_ifs025"),
    ("gfs", "GFS", "NOAA (USA)", "open-meteo", "gfs_seamless"),
    ("swiss1", "Swiss HD 1 km", "MeteoSwiss ICON-CH1, bis etwa 50° Nord", "open-meteo", "meteoswiss_icon_ch1"),
    ("swiss2", "Swiss HD 2 km", "MeteoSwiss ICON-CH2, bis etwa 50° Nord", "open-meteo", "meteoswiss_icon_ch2"),
    ("metno", "MET Norway", "Norwegischer Wetterdienst", "met-norway", None),
]
FINE = ["icon_d2", "knmi", "dmi", "arome", "swiss1", "swiss2"]
SIX_HOUR_MODEL = "metno"
SHORT_RANGE = ["swiss1", "icon_d2", "swiss2", "icon_eu", "ecmwf", "gfs", "metno"]
# kinds of precipitation in display order
KINDS = {
    "Niesel": ["niesel"], "Regen": ["regen", "starkregen", "schauer"],
    "gefrierender Regen": ["glatteis"], "Schneeregen": ["schneeregen"],
    "Schnee": ["schnee", "schneeschauer"], "Gewitter": ["gewitter"],
}
# parts of the day: (key, from hour, to hour)
DAY_PARTS = [("nacht", 0, 6), ("morgen", 6, 9), ("vormittag", 9, 12), ("mittag", 12, 15),
             ("nachmittag", 15, 18), ("abend", 18, 21), ("spaet", 21, 24)]
CHANGEABLE_FROM = 50
STORM_KMH, HEAVY_RAIN = 75.0, 15.0
# --------------------------------------------------------------------------------
VARIABLES = ["temp", "wolken", "regen", "wind", "boe", "wkt"]


def local_day(t: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(t, ZONE))


def local_hour(t: Column) -> Column:
    return F.hour(F.from_utc_timestamp(t, ZONE))


def _at(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def _running_hour(now) -> Column:
    return _at(now) - F.expr("INTERVAL 1 HOUR")


def forecast_table(hours: DataFrame, errors: DataFrame | None = None,
                   models: Sequence[tuple] = tuple(MODELS)) -> DataFrame:
    """Catalogue entries beside the rows; a model that failed is one row with its error."""
    spark = hours.sparkSession
    catalogue = spark.createDataFrame(
        [tuple(m[:4]) for m in models], "modell string, name string, text string, quelle string")
    rows = hours.withColumn("fehler", F.lit(None).cast("string"))
    if errors is not None:
        rows = rows.unionByName(errors.select("ort", "modell", "fehler"), allowMissingColumns=True)
    # the catalogue is the fixed list above (or the caller's argument): a handful of rows
    return rows.join(F.broadcast(catalogue), "modell", "left")


def hourly_only(fc: DataFrame, model: str = SIX_HOUR_MODEL) -> DataFrame:
    """Take out the model's rows that stand for six hours."""
    seconds = F.unix_timestamp("zeit")
    mine = with_neighbours(fc.where(F.col("modell") == model).withColumn("_t", seconds),
                           ["ort", "modell"], "_t", F.floor(F.col("_t") / 86400))
    wide = F.coalesce(F.col("danach") - F.col("_t"), F.col("_t") - F.col("davor"), F.lit(0)) > 3600
    rest = fc.where(F.col("modell").isNull() | (F.col("modell") != model))
    return rest.unionByName(mine.where(~wide).select(*fc.columns))


def _symbol_weights(weight: Column) -> list[Column]:
    """One sum per symbol: the number of symbols is fixed, so one aggregation is enough."""
    return [F.sum(F.when(F.col("symbol") == s, weight).otherwise(0)).alias(f"_g_{s}")
            for s in [*WET_SYMBOLS, *DRY_SYMBOLS]]


def _majority() -> Column:
    wet = sum((F.col(f"_g_{s}") for s in WET_SYMBOLS), F.lit(0))
    dry = sum((F.col(f"_g_{s}") for s in DRY_SYMBOLS), F.lit(0))

    def heaviest(names, rank_sign):
        return F.array_max(F.array(*[
            F.when(F.col(f"_g_{s}") > 0, F.struct(
                F.col(f"_g_{s}").alias("g"), F.lit(rank_sign * i).alias("r"), F.lit(s).alias("s")))
            for i, s in enumerate(names)]))["s"]

    return F.when((wet > 0) & (wet * 2 >= wet + dry), heaviest(WET_SYMBOLS, -1)).otherwise(
        heaviest(DRY_SYMBOLS, 1))


def _weight(fine: Sequence[str]) -> Column:
    return F.when(F.col("modell").isin(list(fine)), 2).otherwise(1)


def majority_symbol(fc: DataFrame, fine: Sequence[str] = tuple(FINE)) -> DataFrame:
    """Per hour the symbol of the majority; wet symbols win from half of the weight."""
    return (
        fc.where(F.col("symbol").isNotNull()).groupBy("ort", "zeit")
        .agg(*_symbol_weights(_weight(fine))).select("ort", "zeit", _majority().alias("symbol"))
    )


def ensemble_mean(fc: DataFrame, fine: Sequence[str] = tuple(FINE),
                  order: Sequence[str] = tuple(m[0] for m in MODELS),
                  six_hour_model: str = SIX_HOUR_MODEL) -> DataFrame:
    """Weighted mean of the models per hour, spread, majority symbol, in one aggregation."""
    w = _weight(fine)
    rows = hourly_only(fc, six_hour_model).where(F.col("temp").isNotNull())
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("modell"))
    flag = F.when(F.col("ist_tag").isNotNull(), F.struct(
        F.when(place > 0, place).otherwise(len(order) + 1).alias("o"), F.col("modell").alias("m"),
        F.col("ist_tag").alias("tag")))
    means = [(F.sum(F.col(v) * w) / F.sum(F.when(F.col(v).isNotNull(), w))).alias(v)
             for v in VARIABLES]
    return (
        rows.groupBy("ort", "zeit").agg(
            *means, *_symbol_weights(w), F.min(flag)["tag"].alias("ist_tag"),
            F.count(F.lit(1)).alias("n"), F.min("temp").alias("tmin"), F.max("temp").alias("tmax"),
            F.min("regen").alias("rmin"), F.max("regen").alias("rmax"))
        .select("ort", "zeit", *VARIABLES, _majority().alias("symbol"), "ist_tag", "n", "tmin",
                "tmax", "rmin", "rmax")
    )


def _peak(v: str, largest: bool = True) -> Column:
    key = -F.col(v) if largest else F.col(v)
    return F.min(F.when(F.col(v).isNotNull(), F.struct(key.alias("v"), F.col("zeit").alias("z"))))


def daily_values(fc: DataFrame) -> DataFrame:
    """Per local day: mean, extremes with their first hour, rain with its kinds, gaps."""
    keys = ["ort", "modell", "tag"]
    rows = fc.where(F.col("temp").isNotNull()).withColumn("tag", local_day(F.col("zeit")))
    day = Window.partitionBy(*keys).orderBy("zeit")          # at most 25 hours
    step = F.unix_timestamp("zeit") - F.unix_timestamp(F.lag("zeit").over(day))
    kinds = [F.max(F.col("symbol").isin(names)).alias(f"_k{i}")
             for i, names in enumerate(KINDS.values())]
    out = rows.withColumn("_schritt", step).groupBy(*keys).agg(
        F.avg("temp").alias("mittel"), _peak("temp").alias("_max"),
        _peak("temp", False).alias("_min"), F.sum("regen").alias("regen"),
        _peak("wind").alias("_wind"), _peak("boe").alias("_boe"),
        F.min("zeit").alias("_von"), F.max("zeit").alias("_bis"),
        F.coalesce(F.max(F.col("_schritt") > 3600), F.lit(False)).alias("luecken"), *kinds)
    names = F.filter(F.array(*[F.when(F.col(f"_k{i}"), F.lit(k)) for i, k in enumerate(KINDS)]),
                     lambda k: k.isNotNull())
    return out.select(
        *keys, "mittel", (-F.col("_max.v")).alias("max"), local_hour(F.col("_max.z")).alias("max_h"),
        F.col("_min.v").alias("min"), local_hour(F.col("_min.z")).alias("min_h"), "regen",
        names.alias("arten"), (-F.col("_wind.v")).alias("wind"),
        local_hour(F.col("_wind.z")).alias("wind_h"), (-F.col("_boe.v")).alias("boe"),
        local_hour(F.col("_boe.z")).alias("boe_h"), local_hour(F.col("_von")).alias("von"),
        local_hour(F.col("_bis")).alias("bis"), "luecken")


def short_range(fc: DataFrame, now, first: str | None = None, days: int = 3,
                priority: Sequence[str] = tuple(SHORT_RANGE)) -> DataFrame:
    """Per hour the first model of the list with a value, from the running hour on.

    ``ersatz`` names the model where it is not the place's first one.
    """
    names = ([first] if first else []) + [m for m in priority if m != first]
    prio = F.array_position(F.array(*[F.lit(m) for m in names]), F.col("modell"))
    listed = fc.where(F.col("modell").isin(names)).withColumn("_p", prio)
    leading = listed.groupBy("ort").agg(F.min("_p").alias("_fuehrend"))
    today = local_day(_at(now))
    day = local_day(F.col("zeit"))
    row = F.struct(*[c for c in fc.columns if c not in ("ort", "zeit")], "_p")
    best = (
        listed.where((F.col("zeit") >= _running_hour(now)) & F.col("temp").isNotNull()
                     & day.between(today, F.date_add(today, days - 1)))
        .groupBy("ort", "zeit").agg(F.min_by(row, F.col("_p")).alias("r"))
    )
    return (
        best.select("ort", "zeit", "r.*").join(leading, "ort")
        .withColumns({
            "tag": day, "h": local_hour(F.col("zeit")),
            "ersatz": F.when(F.col("_p") != F.col("_fuehrend"), F.col("modell"))})
        .drop("_p", "_fuehrend")
    )


def short_range_days(fc: DataFrame, now, first: str | None = None, days: int = 3,
                     priority: Sequence[str] = tuple(SHORT_RANGE)) -> DataFrame:
    """Minimum, maximum and rain of each of the days; days without an hour stay."""
    hours = short_range(fc, now, first, days, priority)
    names = ([first] if first else []) + list(priority)
    today = local_day(_at(now))
    grid = fc.where(F.col("modell").isin(names)).select("ort").distinct().select(
        "ort", F.explode(F.sequence(today, F.date_add(today, days - 1))).alias("tag"))
    values = hours.groupBy("ort", "tag").agg(
        F.min("temp").alias("min"), F.max("temp").alias("max"), F.sum("regen").alias("regen"),
        F.count(F.lit(1)).alias("stunden"))
    return grid.join(values, ["ort", "tag"], "left").withColumns({
        "regen": F.coalesce("regen", F.lit(0.0)), "stunden": F.coalesce("stunden", F.lit(0))})


def day_parts(hours: DataFrame) -> DataFrame:
    """Seven parts of each local day (columns ort, tag, h beside the hourly values)."""
    part = None
    for name, lo, hi in DAY_PARTS:
        cond = (F.col("h") >= lo) & (F.col("h") < hi)
        part = F.when(cond, F.lit(name)) if part is None else part.when(cond, F.lit(name))
    wet = F.coalesce(F.col("symbol").isin(WET_SYMBOLS), F.lit(False)) | (
        F.coalesce("regen", F.lit(0.0)) >= 0.1)

    def wet_has(*names):
        return F.count_if(wet & F.col("symbol").isin(list(names)))

    dull = DRY_SYMBOLS[:5]
    values = hours.withColumn("k", part).groupBy("ort", "tag", "k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(wet).alias("_nass"),
        wet_has("gewitter").alias("_gewitter"), wet_has("glatteis").alias("_glatteis"),
        wet_has("schnee", "schneeschauer").alias("_schnee"),
        wet_has("schneeregen").alias("_schneeregen"), wet_has("starkregen").alias("_stark"),
        wet_has("niesel").alias("_niesel"),
        *[F.count_if(F.col("symbol") == s).alias(f"_t_{s}") for s in dull],
        F.min(F.when(F.col("symbol").isNotNull(), F.struct("zeit", "symbol")))["symbol"]
        .alias("_erstes"),
        F.min("h").alias("ab"), F.min("temp").alias("min"), F.max("temp").alias("max"),
        F.coalesce(F.sum("regen"), F.lit(0.0)).alias("regen"), F.max("wkt").alias("wkt"),
        F.max("wind").alias("wind"), F.max("boe").alias("boe"),
        # a part has at most six hours (seven when clocks go back)
        F.sort_array(F.collect_list(F.struct("zeit", "ist_tag"))).alias("_stunden"))
    commonest = F.array_max(F.array(*[
        F.when(F.col(f"_t_{s}") > 0, F.struct(
            F.col(f"_t_{s}").alias("g"), F.lit(i).alias("r"), F.lit(s).alias("s")))
        for i, s in enumerate(dull)]))["s"]
    lasting = F.col("_nass") * 2 >= F.col("n")
    dry = F.col("_nass") == 0
    possible = dry & (F.col("wkt") >= CHANGEABLE_FROM)
    symbol = (
        F.when(possible, "schauer").when(dry, F.coalesce(commonest, F.col("_erstes")))
        .when(F.col("_gewitter") > 0, "gewitter").when(F.col("_glatteis") > 0, "glatteis")
        .when(F.col("_schnee") * 2 > F.col("_nass"),
              F.when(lasting, "schnee").otherwise("schneeschauer"))
        .when(F.col("_schneeregen") > 0, "schneeregen").when(~lasting, "schauer")
        .when(F.col("_stark") > 0, "starkregen")
        .when(F.col("_niesel") == F.col("_nass"), "niesel").otherwise("regen"))
    kind = (F.when(possible, "möglich").when(dry, "trocken").when(lasting, "anhaltend")
            .otherwise("zeitweise"))
    grid = hours.select("ort", "tag").distinct().select("ort", "tag", F.inline(F.array(*[
        F.struct(F.lit(i).alias("nr"), F.lit(name).alias("k"))
        for i, (name, *_) in enumerate(DAY_PARTS)])))
    middle = F.try_element_at("_stunden", F.floor(F.col("n") / 2).cast("int") + 1)
    return (
        grid.join(values, ["ort", "tag", "k"], "left")
        .select("ort", "tag", "nr", "k", F.col("n").isNull().alias("leer"), "ab",
                F.when(F.col("n").isNotNull(), symbol).alias("symbol"),
                F.when(F.col("n").isNotNull(), kind).alias("art"), "min", "max", "regen", "wkt",
                "wind", "boe", middle["ist_tag"].alias("ist_tag"))
    )


def remaining_hours(fc: DataFrame, now) -> DataFrame:
    """Rows from the running hour on, each with its local day and that day's values."""
    rows = fc.where(F.col("zeit") >= _running_hour(now)).withColumn(
        "tag", local_day(F.col("zeit")))
    days = daily_values(fc)
    days = days.select("ort", "modell", "tag", *[
        F.col(c).alias(f"tag_{c}") for c in days.columns if c not in ("ort", "modell", "tag")])
    return rows.join(days, ["ort", "modell", "tag"], "left")


def three_hour_raster(main: DataFrame, spare: DataFrame, now) -> DataFrame:
    """Three local days every three hours; the spare forecast fills what the main one lacks."""
    value = ["ort", "zeit", "temp", "symbol", "ist_tag"]
    both = (
        main.where(F.col("temp").isNotNull()).select(*value, F.lit(0).alias("_e"))
        .unionByName(spare.where(F.col("temp").isNotNull()).select(*value, F.lit(1).alias("_e")))
    )
    today = F.date_trunc("day", F.from_utc_timestamp(_at(now), ZONE))
    local = F.col("_d") * F.expr("INTERVAL 1 DAY") + F.col("_h") * F.expr("INTERVAL 1 HOUR") + today
    slots = (
        both.select("ort").distinct()
        .select("ort", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_d"))
        .select("ort", "_d", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("_h"))
        .withColumn("zeit", F.to_utc_timestamp(local, ZONE))
    )
    best = both.groupBy("ort", "zeit").agg(
        F.min_by(F.struct("temp", "symbol", "ist_tag", "_e"), F.col("_e")).alias("r"))
    day = Window.partitionBy("ort", "_d")                     # 24 slots
    past = F.col("zeit") + F.expr("INTERVAL 3 HOUR") <= _at(now)
    shown = ~past & F.col("r").isNotNull()
    return (
        slots.join(best, ["ort", "zeit"], "left")
        .withColumns({"tag_min": F.min("r.temp").over(day), "tag_max": F.max("r.temp").over(day)})
        .where(F.col("_h") % 3 == 0)
        .select("ort", F.col("_d").alias("tag_nr"), F.col("_h").alias("h"), "zeit",
                F.when(shown, F.col("r.temp")).alias("temp"),
                F.when(shown, F.col("r.symbol")).alias("symbol"),
                F.when(shown, F.col("r.ist_tag")).alias("ist_tag"),
                F.when(shown, F.col("r._e") == 1).alias("ersatz"), "tag_min", "tag_max")
    )


def hourly_rain(fc: DataFrame) -> Column:
    """Rain of one hour; a column ``sechs_stunden`` marks sums of six, which do not count."""
    if "sechs_stunden" not in fc.columns:
        return F.col("regen")
    return F.when(~F.coalesce("sechs_stunden", F.lit(False)), F.col("regen"))


def alert_kinds(fc: DataFrame, storm: float, heavy: float) -> list[tuple[str, Column, Column]]:
    """(kind, condition, value) of what is warned of; in batches and in the stream."""
    rain = hourly_rain(fc)
    return [("sturm", F.col("boe") >= storm, F.col("boe")), ("regen", rain >= heavy, rain),
            ("gewitter", F.col("symbol") == "gewitter", F.lit(None).cast("double"))]


def severe_weather(fc: DataFrame, now, storm: float = STORM_KMH,
                   heavy: float = HEAVY_RAIN) -> DataFrame:
    """Strongest gust, heaviest hourly rain and first thunderstorm of the next 24 hours."""
    window = F.col("zeit").between(_running_hour(now), _at(now) + F.expr("INTERVAL 24 HOUR"))
    kinds = alert_kinds(fc, storm, heavy)
    found = fc.where(window).groupBy("ort", "modell").agg(*[
        F.min(F.when(condition, F.struct((-value).alias("v"), "zeit"))).alias(art)
        for art, condition, value in kinds])
    alerts = F.array(*[
        F.struct(F.lit(art).alias("art"), F.col(f"{art}.zeit").alias("zeit"), (-F.col(f"{art}.v")).alias("wert"))
        for art, _, _ in kinds])
    return (
        found.select("ort", "modell", F.inline(alerts)).where(F.col("zeit").isNotNull())
        .withColumn("tag", local_day(F.col("zeit")))
    )


def new_alerts(alerts: DataFrame, reported: DataFrame) -> DataFrame:
    """Each kind and local day of a place once, and never again once reported."""
    keys = ["ort", "art", "tag"]
    others = [c for c in alerts.columns if c not in keys]
    fresh = alerts.join(reported.select(*keys), keys, "left_anti")
    first = F.min(F.struct("zeit", *[c for c in others if c != "zeit"])).alias("r")
    return fresh.groupBy(*keys).agg(first).select(*keys, "r.*")
