"""Hourly forecasts, their sources, symbols and daylight."""

from __future__ import annotations


from pyspark.sql import functions as F

from isotherm.functions.sky import with_daylight
from isotherm.functions.symbols import DRY_SYMBOLS, TEXT_RULES, WET_SYMBOLS, WMO_SYMBOLS, with_symbol
from isotherm.operators import forecast as H
from isotherm.session import new_folder
from isotherm.sources import derived, forecasts as J
from isotherm.streaming.alerts import stream_alerts
from verification.base import FORECAST, LOCAL, NOW, r, rounded, rs

Q: dict = {}
SQL: dict = {}

FINE = ("click", "view")
ORDER = ("view", "click", "purchase", "signup", "error")
WIDE = "error"                  # plays the model with six-hour steps
MODELS = [("view", "Sicht", "fein", "kombi"), ("click", "Klick", "fein", "kombi"),
          ("purchase", "Kauf", "grob", "kombi"), ("signup", "Neu", "grob", "kombi")]
_NOW = f"TIMESTAMP '{NOW}'"


def fc(s, d):
    return derived.forecast(s, d)


def with_fc(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([FORECAST, *ctes]) + "\n" + select


_COLS = "ort, modell, zeit, " + rs("temp", "wolken", "regen", "wind", "boe", "wkt") + ", symbol, ist_tag"

# ---- blending ---------------------------------------------------------------------
Q["forecast_table"] = lambda s, d: rounded(H.forecast_table(
    fc(s, d).where(F.col("modell") != WIDE), s.createDataFrame([(1, WIDE, "ausgefallen")], "ort int, modell string, fehler string")
    .join(fc(s, d).select("ort").distinct(), "ort"), MODELS))
SQL["forecast_table"] = with_fc(f"""SELECT {_COLS}, NULL::VARCHAR AS fehler, name, text, quelle FROM fc LEFT JOIN (VALUES
{', '.join(str(m) for m in MODELS)}) m(id, name, text, quelle) ON id = modell WHERE modell <> '{WIDE}'
UNION ALL SELECT 1, '{WIDE}', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'ausgefallen', NULL, NULL, NULL""")
_WIDE = f"""breit AS (SELECT *, lead(zeit) OVER w AS nach, lag(zeit) OVER w AS vor FROM fc WHERE modell = '{WIDE}'
WINDOW w AS (PARTITION BY ort ORDER BY zeit)), fein AS (SELECT * FROM fc WHERE modell <> '{WIDE}' UNION ALL
SELECT * EXCLUDE (nach, vor) FROM breit WHERE NOT coalesce(nach - zeit > INTERVAL 1 HOUR,
 zeit - vor > INTERVAL 1 HOUR, false))"""
Q["hourly_only"] = lambda s, d: rounded(H.hourly_only(fc(s, d), WIDE))
SQL["hourly_only"] = with_fc(f"SELECT {_COLS} FROM fein", _WIDE)
_WETLIST = "[" + ", ".join(f"'{x}'" for x in WET_SYMBOLS) + "]"
_DRYLIST = "[" + ", ".join(f"'{x}'" for x in DRY_SYMBOLS) + "]"


def _majority(src: str, name: str = "mehr") -> str:
    return f"""{name}_g AS (SELECT ort, zeit, symbol, sum(CASE WHEN modell IN {FINE} THEN 2 ELSE 1 END) AS g,
list_contains({_WETLIST}, symbol) AS nass FROM {src} WHERE symbol IS NOT NULL GROUP BY ALL),
{name} AS (SELECT ort, zeit, symbol FROM (SELECT *, sum(CASE WHEN nass THEN g ELSE 0 END) OVER w AS n, sum(g) OVER w AS a
 FROM {name}_g WINDOW w AS (PARTITION BY ort, zeit)) WHERE nass = (n > 0 AND n * 2 >= a)
QUALIFY row_number() OVER (PARTITION BY ort, zeit ORDER BY g DESC,
 CASE WHEN nass THEN -list_position({_WETLIST}, symbol) ELSE list_position({_DRYLIST}, symbol) END DESC) = 1)"""


Q["majority_symbol"] = lambda s, d: H.majority_symbol(fc(s, d), FINE)
SQL["majority_symbol"] = with_fc("SELECT * FROM mehr", _majority("fc"))
_W = f"(CASE WHEN modell IN {FINE} THEN 2 ELSE 1 END)"
_ORDER = "[" + ", ".join(f"'{m}'" for m in ORDER) + "]"
_MEAN = ", ".join(f"sum({v} * {_W}) / sum(CASE WHEN {v} IS NOT NULL THEN {_W} END) AS {v}" for v in H.VARIABLES)
_BLEND = [_WIDE, _majority("fein"), f"""mittel AS (SELECT m.*, mehr.symbol FROM (SELECT ort, zeit, {_MEAN},
arg_min(ist_tag, list_position({_ORDER}, modell)) FILTER (ist_tag IS NOT NULL) AS ist_tag, count(*) AS n,
min(temp) AS tmin, max(temp) AS tmax, min(regen) AS rmin, max(regen) AS rmax FROM fein GROUP BY ALL) m
LEFT JOIN mehr USING (ort, zeit))"""]
Q["ensemble_mean"] = lambda s, d: rounded(H.ensemble_mean(fc(s, d), FINE, ORDER, WIDE))
SQL["ensemble_mean"] = with_fc(f"""SELECT ort, zeit, {rs(*H.VARIABLES)}, symbol, ist_tag, n,
{rs('tmin', 'tmax', 'rmin', 'rmax')} FROM mittel""", *_BLEND)

# ---- daily values ----------------------------------------------------------------------
_DAY = f"{LOCAL}::DATE"
_KINDS = "[" + ", ".join(f"'{k}'" for k in H.KINDS) + "]"
_KIND = "CASE " + " ".join(f"WHEN symbol IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in H.KINDS.items()) + " END"


def _peaks(v: str, fn: str, name: str) -> str:
    order = f"{v} DESC" if fn == "max" else v
    return (f"{r(f'{fn}({v})', name)}, hour(first({LOCAL} ORDER BY {order}, zeit) FILTER ({v} IS NOT NULL)) AS {name}_h")


_DAILY = f"""tagw AS (SELECT ort, modell, tag, {r('avg(temp)', 'mittel')}, {_peaks('temp', 'max', 'max')},
{_peaks('temp', 'min', 'min')}, {r('sum(regen)', 'regen')},
array_to_string(list_filter({_KINDS}, lambda x: list_contains(list(art), x)), ',') AS arten,
{_peaks('wind', 'max', 'wind')}, {_peaks('boe', 'max', 'boe')}, hour(min({LOCAL})) AS von, hour(max({LOCAL})) AS bis,
coalesce(bool_or(schritt > INTERVAL 1 HOUR), false) AS luecken
FROM (SELECT *, {_KIND} AS art, zeit - lag(zeit) OVER (PARTITION BY ort, modell, tag ORDER BY zeit) AS schritt
      FROM (SELECT *, {_DAY} AS tag FROM fc)) GROUP BY ort, modell, tag)"""


def _joined_kinds(df, name="arten"):
    return df.withColumn(name, F.concat_ws(",", name))


Q["daily_values"] = lambda s, d: rounded(_joined_kinds(H.daily_values(fc(s, d))))
SQL["daily_values"] = with_fc("SELECT * FROM tagw", _DAILY)
_TAGCOLS = ["mittel", "max", "max_h", "min", "min_h", "regen", "arten", "wind", "wind_h", "boe", "boe_h", "von", "bis", "luecken"]
Q["remaining_hours"] = lambda s, d: rounded(_joined_kinds(H.remaining_hours(fc(s, d), NOW), "tag_arten"))
SQL["remaining_hours"] = with_fc(f"""SELECT f.ort, f.modell, f.tag, zeit, {rs('f.temp', 'f.wolken', 'f.regen', 'f.wind', 'f.boe', 'f.wkt')},
symbol, ist_tag, {', '.join(f't.{c} AS tag_{c}' for c in _TAGCOLS)} FROM (SELECT *, {_DAY} AS tag FROM fc) f
LEFT JOIN tagw t USING (ort, modell, tag) WHERE zeit >= {_NOW} - INTERVAL 1 HOUR""", _DAILY)

# ---- short range, day parts, raster, warnings ----------------------------------------------
PRIO = ("signup", "view", "click", "purchase")


def _short(names) -> list[str]:
    lst = "[" + ", ".join(f"'{m}'" for m in names) + "]"
    return [f"""kurz AS (SELECT k.ort, k.zeit, k.modell, temp, wolken, regen, wind, boe, symbol, ist_tag, wkt, {_DAY.replace('zeit', 'k.zeit')} AS tag,
hour({LOCAL.replace('zeit', 'k.zeit')}) AS h, CASE WHEN p <> f THEN k.modell END AS ersatz FROM (SELECT *, list_position({lst}, modell) AS p FROM fc
 WHERE list_contains({lst}, modell) AND zeit >= {_NOW} - INTERVAL 1 HOUR AND temp IS NOT NULL
 AND {_DAY} BETWEEN ({_NOW} + INTERVAL 1 HOUR)::DATE AND ({_NOW} + INTERVAL 1 HOUR)::DATE + 2
 QUALIFY row_number() OVER (PARTITION BY ort, zeit ORDER BY list_position({lst}, modell)) = 1) k
JOIN (SELECT ort, min(list_position({lst}, modell)) AS f FROM fc WHERE list_contains({lst}, modell) GROUP BY ort) USING (ort))"""]


_SHORTCOLS = f"ort, zeit, modell, {rs('temp', 'wolken', 'regen', 'wind', 'boe', 'wkt')}, symbol, ist_tag, tag, h, ersatz"
Q["short_range"] = lambda s, d: rounded(H.short_range(fc(s, d), NOW, priority=PRIO))
SQL["short_range"] = with_fc(f"SELECT {_SHORTCOLS} FROM kurz", *_short(PRIO))
Q["short_range_chosen"] = lambda s, d: rounded(H.short_range(fc(s, d), NOW, "purchase", priority=PRIO))
SQL["short_range_chosen"] = with_fc(f"SELECT {_SHORTCOLS} FROM kurz", *_short(("purchase", "signup", "view", "click")))
Q["short_range_days"] = lambda s, d: rounded(H.short_range_days(fc(s, d), NOW, priority=PRIO))
SQL["short_range_days"] = with_fc(f"""SELECT ort, tag, {r('min(temp)', 'min')}, {r('max(temp)', 'max')},
{r('coalesce(sum(regen), 0)', 'regen')}, count(zeit) AS stunden FROM (SELECT DISTINCT ort,
 unnest(generate_series(({_NOW})::DATE, ({_NOW})::DATE + 2, INTERVAL 1 DAY))::DATE AS tag FROM fc) LEFT JOIN kurz USING (ort, tag)
GROUP BY ort, tag""", *_short(PRIO))


def _dayhours(s, d):
    """One row per place and local hour, from the blended models."""
    rows = H.ensemble_mean(fc(s, d), FINE, ORDER, WIDE)
    return rows.withColumns({"tag": H.local_day(F.col("zeit")), "h": H.local_hour(F.col("zeit")),
                             "wkt": F.col("wkt") / 2, "regen": F.col("regen") / 20})


_PARTCASE = "CASE " + " ".join(f"WHEN h >= {a} AND h < {b} THEN '{n}'" for n, a, b in H.DAY_PARTS) + " END"
_WETS = "(" + ", ".join(f"'{x}'" for x in WET_SYMBOLS) + ")"
Q["day_parts"] = lambda s, d: rounded(H.day_parts(_dayhours(s, d)))
SQL["day_parts"] = with_fc(f"""SELECT g.ort, g.tag, g.nr, g.k, n IS NULL AS leer, ab,
CASE WHEN n IS NULL THEN NULL WHEN nn = 0 AND wkt >= 50 THEN 'schauer' WHEN nn = 0 THEN coalesce(haeufig, erstes)
 WHEN gew THEN 'gewitter' WHEN gla THEN 'glatteis' WHEN sch * 2 > nn THEN CASE WHEN nn * 2 >= n THEN 'schnee' ELSE 'schneeschauer' END
 WHEN sr THEN 'schneeregen' WHEN nn * 2 < n THEN 'schauer' WHEN st THEN 'starkregen' WHEN nur THEN 'niesel' ELSE 'regen' END AS symbol,
CASE WHEN n IS NULL THEN NULL WHEN nn = 0 AND wkt >= 50 THEN 'möglich' WHEN nn = 0 THEN 'trocken' WHEN nn * 2 >= n THEN 'anhaltend' ELSE 'zeitweise' END AS art,
{rs('mn', 'mx').replace('AS mn', 'AS min').replace('AS mx', 'AS max')}, {rs('regen', 'wkt', 'wind', 'boe')}, ist_tag
FROM (SELECT ort, tag, nr, k FROM (SELECT DISTINCT ort, tag FROM st), (VALUES {', '.join(f"({i}, '{n}')" for i, (n, *_) in enumerate(H.DAY_PARTS))}) t(nr, k)) g
LEFT JOIN (SELECT ort, tag, {_PARTCASE} AS k, count(*) AS n, count(*) FILTER (nass) AS nn, coalesce(bool_or(nass AND symbol = 'gewitter'), false) AS gew,
 coalesce(bool_or(nass AND symbol = 'glatteis'), false) AS gla, count(*) FILTER (nass AND symbol IN ('schnee', 'schneeschauer')) AS sch,
 coalesce(bool_or(nass AND symbol = 'schneeregen'), false) AS sr, coalesce(bool_or(nass AND symbol = 'starkregen'), false) AS st,
 count(*) FILTER (nass AND symbol = 'niesel') = count(*) FILTER (nass) AS nur, min(h) AS ab, min(temp) AS mn, max(temp) AS mx,
 coalesce(sum(regen), 0) AS regen, max(wkt) AS wkt, max(wind) AS wind, max(boe) AS boe,
 arg_min(symbol, zeit) FILTER (symbol IS NOT NULL) AS erstes, list(ist_tag ORDER BY zeit)[count(*) // 2 + 1] AS ist_tag
 FROM st GROUP BY ALL) v ON v.ort = g.ort AND v.tag = g.tag AND v.k = g.k
LEFT JOIN (SELECT ort, tag, {_PARTCASE} AS k, symbol AS haeufig FROM st WHERE symbol IN ('klar','heiter','wolkig','bedeckt','nebel')
 GROUP BY ort, tag, {_PARTCASE}, symbol QUALIFY row_number() OVER (PARTITION BY ort, tag, {_PARTCASE} ORDER BY count(*) DESC,
 list_position({_DRYLIST}, symbol) DESC) = 1) hf ON hf.ort = g.ort AND hf.tag = g.tag AND hf.k = g.k""", *_BLEND,
    f"""st AS (SELECT ort, zeit, temp, regen / 20 AS regen, wkt / 2 AS wkt, wind, boe, symbol, ist_tag, {_DAY} AS tag, hour({LOCAL}) AS h,
coalesce(symbol IN {_WETS}, false) OR coalesce(regen / 20, 0) >= 0.1::DOUBLE AS nass FROM mittel)""")


def _raster(s, d):
    main = fc(s, d).where("modell = 'view'")
    return rounded(H.three_hour_raster(main, H.ensemble_mean(fc(s, d), FINE, ORDER, WIDE), NOW))


Q["three_hour_raster"] = _raster
SQL["three_hour_raster"] = with_fc(f"""SELECT ort, tag_nr, h, zeit, {r('CASE WHEN da THEN temp END', 'temp')},
CASE WHEN da THEN symbol END AS symbol, CASE WHEN da THEN ist_tag END AS ist_tag, CASE WHEN da THEN e = 1 END AS ersatz,
{rs('tag_min', 'tag_max')} FROM (SELECT g.*, b.temp, b.symbol, b.ist_tag, b.e,
 NOT (g.zeit + INTERVAL 3 HOUR <= {_NOW}) AND b.temp IS NOT NULL AS da,
 min(b.temp) OVER (PARTITION BY g.ort, tag_nr) AS tag_min, max(b.temp) OVER (PARTITION BY g.ort, tag_nr) AS tag_max
 FROM (SELECT DISTINCT fc.ort, t AS tag_nr, h, ({_NOW} + INTERVAL 1 HOUR)::DATE + to_days(t::INTEGER) + to_hours(h) - INTERVAL 1 HOUR AS zeit
       FROM fc, range(0, 3) a(t), range(0, 24) b(h)) g
 LEFT JOIN (SELECT ort, zeit, temp, symbol, ist_tag, 0 AS e FROM fc WHERE modell = 'view' AND temp IS NOT NULL UNION ALL
  SELECT ort, zeit, temp, symbol, ist_tag, 1 FROM mittel WHERE (ort, zeit) NOT IN (SELECT (ort, zeit) FROM fc WHERE modell = 'view')) b
 ON b.ort = g.ort AND b.zeit = g.zeit) WHERE h % 3 = 0""", *_BLEND)
_SEVERE = f"""unw AS (SELECT ort, modell, art, zeit, wert, {_DAY} AS tag FROM (
SELECT ort, modell, 'sturm' AS art, arg_min(zeit, (-boe, zeit)) AS zeit, max(boe) AS wert FROM nah WHERE boe >= 23 GROUP BY ALL
UNION ALL SELECT ort, modell, 'regen', arg_min(zeit, (-regen, zeit)), max(regen) FROM nah WHERE regen >= 5 GROUP BY ALL
UNION ALL SELECT ort, modell, 'gewitter', min(zeit), NULL FROM nah WHERE symbol = 'gewitter' GROUP BY ALL))"""
_NEAR = f"nah AS (SELECT * FROM fc WHERE zeit BETWEEN {_NOW} - INTERVAL 1 HOUR AND {_NOW} + INTERVAL 24 HOUR)"
Q["severe_weather"] = lambda s, d: rounded(H.severe_weather(fc(s, d), NOW, 23.0, 5.0))
SQL["severe_weather"] = with_fc(f"SELECT ort, modell, art, zeit, {r('wert', 'wert')}, tag FROM unw", _NEAR, _SEVERE)


def _new_alerts(s, d):
    alerts = H.severe_weather(fc(s, d), NOW, 23.0, 5.0)
    return rounded(H.new_alerts(alerts, alerts.where("modell = 'view'").select("ort", "art", "tag")))


Q["new_alerts"] = _new_alerts
SQL["new_alerts"] = with_fc(f"""SELECT ort, art, tag, zeit, modell, {r('wert', 'wert')} FROM unw
WHERE (ort, art, tag) NOT IN (SELECT (ort, art, tag) FROM unw WHERE modell = 'view')
QUALIFY row_number() OVER (PARTITION BY ort, art, tag ORDER BY zeit, modell) = 1""", _NEAR, _SEVERE)

# ---- symbols and daylight ----------------------------------------------------------------------
Q["wmo_symbols"] = lambda s, d: with_symbol(derived.table(s, d, "events").select(
    "event_id", (F.col("user_id") % 101).alias("weather_code")), "wmo")
SQL["wmo_symbols"] = f"""SELECT event_id, user_id % 101 AS weather_code, CASE {' '.join(f"WHEN user_id % 101 IN ({', '.join(map(str, c))}) THEN '{n}'" for n, c in WMO_SYMBOLS.items())}
WHEN user_id % 101 >= 95 THEN 'gewitter' END AS symbol FROM events"""
_TEXTS = ["clearsky_day", "fair_night", "partlycloudy_day", "cloudy", "fog", "lightrain", "rain", "heavyrain",
          "rainshowers_night", "heavyrainandthunder", "sleetshowers_day", "snowshowers_polartwilight", "lightsnow", "", "dust"]
_ICONS = ["clear-day", "clear-night", "partly-cloudy-day", "cloudy", "fog", "wind", "rain", "sleet", "snow", "hail",
          "thunderstorm", "partly-cloudy-night", "", "dust-day"]


def _pick(texts):
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % len(texts) + 1).cast("int"))


def _pick_sql(texts):
    return "[" + ", ".join(f"'{t}'" for t in texts) + f"][event_id % {len(texts)} + 1]"


Q["text_symbols"] = lambda s, d: with_symbol(derived.table(s, d, "events").select("event_id", _pick(_TEXTS).alias("symbol_code")), "text")
SQL["text_symbols"] = f"""SELECT event_id, t AS symbol_code, CASE WHEN t = '' THEN NULL {' '.join((f"WHEN contains(b, '{x}')" if k == 'contains' else f"WHEN b = '{x}'") + f" THEN '{n}'" for k, x, n in TEXT_RULES)} END AS symbol,
CASE WHEN contains(t, '_') THEN t LIKE '%_day' END AS ist_tag FROM (SELECT event_id, t, split_part(t, '_', 1) AS b FROM (SELECT event_id, {_pick_sql(_TEXTS)} AS t FROM events))"""
Q["icon_symbols"] = lambda s, d: with_symbol(derived.table(s, d, "events").select("event_id", _pick(_ICONS).alias("icon")), "icon")
SQL["icon_symbols"] = f"""SELECT event_id, t AS icon, CASE regexp_replace(t, '-(day|night)$', '') WHEN 'clear' THEN 'klar' WHEN 'partly-cloudy' THEN 'wolkig'
WHEN 'cloudy' THEN 'bedeckt' WHEN 'fog' THEN 'nebel' WHEN 'wind' THEN 'wind' WHEN 'rain' THEN 'regen' WHEN 'sleet' THEN 'schneeregen'
WHEN 'snow' THEN 'schnee' WHEN 'hail' THEN 'gewitter' WHEN 'thunderstorm' THEN 'gewitter' END AS symbol,
CASE WHEN t LIKE '%-day' THEN true WHEN t LIKE '%-night' THEN false END AS ist_tag FROM (SELECT event_id, {_pick_sql(_ICONS)} AS t FROM events)"""


def _light(s, d):
    place = derived.places(s, d).select(F.col("id").alias("user_id"), "lat", "lon")
    rows = derived.table(s, d, "events").select(
        "event_id", "user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("zeit"),
        F.when(F.col("event_id") % 11 == 0, F.col("event_id") % 2 == 0).alias("ist_tag"))
    return with_daylight(rows.join(place, "user_id", "left")).select("event_id", "hell")


Q["daylight"] = _light
_SEC = "((epoch(zeit) + 1800) / 86400.0::DOUBLE - 10957.5::DOUBLE)"
SQL["daylight"] = f"""SELECT event_id, coalesce(ist_tag, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN
degrees(asin(sin(radians(lat)) * sin(dek) + cos(radians(lat)) * cos(dek) * cos(h))) > -0.833::DOUBLE
ELSE hour({LOCAL}) BETWEEN 7 AND 18 END) AS hell FROM (
SELECT *, asin(sin(e) * sin(l)) AS dek, radians(280.46061837::DOUBLE + 360.98564736629::DOUBLE * t + lon) - atan2(cos(e) * sin(l), cos(l)) AS h FROM (
SELECT *, radians(280.459::DOUBLE + 0.98564736::DOUBLE * t + 1.915::DOUBLE * sin(g) + 0.02::DOUBLE * sin(2 * g)) AS l FROM (
SELECT *, radians(357.529::DOUBLE + 0.98560028::DOUBLE * t) AS g, radians(23.439::DOUBLE - 0.00000036::DOUBLE * t) AS e FROM (
SELECT event_id, zeit, ist_tag, lat, lon, {_SEC} AS t FROM (SELECT event_id, user_id, date_trunc('hour', ts) AS zeit,
 CASE WHEN event_id % 11 = 0 THEN event_id % 2 = 0 END AS ist_tag FROM events) LEFT JOIN
 (SELECT c_custkey AS user_id, 47.5::DOUBLE + (c_custkey * 37 % 700) / 100.0::DOUBLE AS lat,
  6.5::DOUBLE + (c_custkey * 53 % 800) / 100.0::DOUBLE AS lon FROM customer) USING (user_id)))))"""

# ---- answers of the services, written from the events ---------------------------------------------
# one answer per event and model with three hours; the second has no values, short arrays end early


def _answers(s, d):
    v, hour = F.col("value"), F.date_trunc("hour", F.col("ts").cast("timestamp"))

    def stamp(h):
        return F.date_format(hour + F.expr(f"INTERVAL {h} HOUR"), "yyyy-MM-dd'T'HH:mm")

    body = F.to_json(F.struct(
        F.array(*[stamp(h) for h in range(3)]).alias("time"),
        F.array(F.floor(v) / 8, F.lit(None), F.floor(v) / 4).alias("temperature_2m"),
        F.array(F.floor(v) / 2, F.lit(None)).alias("cloud_cover"),
        F.array(F.floor(v) / 10, v, v).alias("precipitation"),
        F.array(F.floor(v)).alias("wind_speed_10m"), F.array(F.floor(v) + 1).alias("wind_gusts_10m"),
        F.array(F.col("user_id") % 4, F.lit(0), F.lit(61)).alias("weather_code"),
        F.array(F.lit(1), F.lit(0), F.lit(0)).alias("is_day"),
        F.array(F.col("user_id") % 100).alias("precipitation_probability")), {"ignoreNullFields": "false"})
    broken = F.when(F.col("event_id") % 5 == 0, F.lit('{"error": true, "reason": "No data is available for this location"}')) \
        .when(F.col("event_id") % 7 == 0, F.lit('{"error": true, "reason": "Daily API request limit exceeded"}')) \
        .when(F.col("event_id") % 11 == 0, F.lit('{"hourly": {"time": []}}'))
    return derived.table(s, d, "events").select(
        F.col("event_id").alias("ort"), F.col("event_type").alias("modell"),
        F.coalesce(broken, F.concat(F.lit('{"hourly": '), body, F.lit("}"))).alias("antwort"))


_E5 = "event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0"
Q["read_forecast"] = lambda s, d: J.read_forecast(_answers(s, d))[0]
SQL["read_forecast"] = f"""SELECT event_id AS ort, event_type AS modell, date_trunc('hour', ts) AS zeit, round_even(floor(value) / 8, 1) AS temp,
round_even(floor(value) / 2, 0) AS wolken, round_even(floor(value) / 10, 1) AS regen, floor(value) AS wind, floor(value) + 1 AS boe,
['klar','heiter','wolkig','bedeckt'][user_id % 4 + 1] AS symbol, true AS ist_tag, (user_id % 100)::DOUBLE AS wkt FROM events WHERE {_E5}
UNION ALL SELECT event_id, event_type, date_trunc('hour', ts) + INTERVAL 2 HOUR, round_even(floor(value) / 4, 1), NULL, printf('%.1f', value)::DOUBLE, NULL, NULL, 'regen', false, NULL
FROM events WHERE {_E5}"""
Q["forecast_errors"] = lambda s, d: J.read_forecast(_answers(s, d))[1]
SQL["forecast_errors"] = f"""SELECT event_id AS ort, event_type AS modell, CASE WHEN event_id % 5 = 0 THEN '{J.OUTSIDE_TEXT}'
WHEN event_id % 7 = 0 THEN '{J.LIMIT_TEXT}' ELSE '{J.EMPTY_TEXT}' END AS fehler FROM events WHERE NOT ({_E5})"""
_SPLIT = (("a", "eins"), ("b", "zwei"), ("c", "drei"))


def _combined(s, d):
    v, hour = F.col("value"), F.date_trunc("hour", F.col("ts").cast("timestamp"))
    body = F.to_json(F.struct(
        F.array(F.date_format(hour, "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.array(F.floor(v) / 8).alias("temperature_2m_eins"), F.array(F.lit(63)).alias("weather_code_eins"),
        F.when(F.col("event_id") % 3 != 0, F.array(F.floor(v) / 4)).alias("temperature_2m_zwei")))
    return derived.table(s, d, "events").select(
        F.col("event_id").alias("ort"), F.concat(F.lit('{"hourly": '), body, F.lit("}")).alias("antwort"))


def _split(s, d):
    rows, errors = J.split_models(_combined(s, d), _SPLIT)
    return rows.select("ort", "modell", "zeit", "temp", "symbol", F.lit(None).cast("string").alias("fehler")).unionByName(
        errors, allowMissingColumns=True)


Q["split_models"] = _split
SQL["split_models"] = f"""SELECT event_id AS ort, 'a' AS modell, date_trunc('hour', ts) AS zeit, round_even(floor(value) / 8, 1) AS temp, 'regen' AS symbol, NULL AS fehler FROM events
UNION ALL SELECT event_id, 'b', date_trunc('hour', ts), round_even(floor(value) / 4, 1), NULL, NULL FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, 'b', NULL, NULL, NULL, '{J.OUTSIDE_TEXT}' FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'c', NULL, NULL, NULL, '{J.OUTSIDE_TEXT}' FROM events"""


def _series(s, d):
    v, hour = F.col("value"), F.date_trunc("hour", F.col("ts").cast("timestamp"))

    def entry(i, ahead):
        details = F.struct((F.floor(v) / 4 + i).alias("air_temperature"), F.floor(v).alias("cloud_area_fraction"),
                           (F.floor(v) / 2).alias("wind_speed"), F.when(F.col("event_id") % 2 == 0, F.floor(v)).alias("wind_speed_of_gust"))
        following = F.struct(F.struct(_pick(_TEXTS).alias("symbol_code")).alias("summary"),
                             F.struct((F.floor(v) / 10).alias("precipitation_amount")).alias("details"))
        data = F.struct(F.struct(details.alias("details")).alias("instant"),
                        F.when(F.lit(ahead == 1), following).alias("next_1_hours"),
                        F.when(F.lit(ahead > 0), following).alias("next_6_hours"))
        return F.struct(F.date_format(hour + F.expr(f"INTERVAL {i} HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), data.alias("data"))

    body = F.to_json(F.struct(F.struct(F.array(entry(0, 1), entry(1, 6), entry(2, 0), entry(3, 1)).alias("timeseries")).alias("properties")))
    return derived.table(s, d, "events").select(F.col("event_id").alias("ort"), F.col("event_type").alias("modell"), body.alias("antwort"))


Q["read_timeseries"] = lambda s, d: J.read_timeseries(_series(s, d), 3)[0].drop("symbol", "ist_tag")
SQL["read_timeseries"] = """SELECT event_id AS ort, event_type AS modell, date_trunc('hour', ts) + to_hours(i) AS zeit, round_even(floor(value) / 4 + i, 1) AS temp,
floor(value) AS wolken, CASE WHEN i < 2 THEN round_even(floor(value) / 10, 1) END AS regen, round_even(floor(value) / 2 * 3.6::DOUBLE, 0) AS wind,
CASE WHEN event_id % 2 = 0 THEN round_even(floor(value) * 3.6::DOUBLE, 0) END AS boe, NULL::DOUBLE AS wkt, i = 1 AS sechs_stunden
FROM events, (VALUES (0), (1), (2)) t(i)"""


def _current(s, d):
    v = F.floor("value")
    weather = F.struct((F.col("event_id") % 3).alias("source_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                       (v / 4).alias("temperature"), v.alias("cloud_cover"), _pick(_ICONS).alias("icon"), (v / 10).alias("precipitation_60"),
                       (v / 2).alias("wind_speed_10"), v.alias("wind_gust_speed_10"), v.alias("relative_humidity"))
    sources = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("station_name"), (v * 100 + i).alias("distance")) for i, n in ((0, "Null"), (1, "Eins"))])
    body = F.when(F.col("event_id") % 13 == 0, F.lit('{"weather": null, "sources": []}')).otherwise(
        F.to_json(F.struct(weather.alias("weather"), sources.alias("sources"))))
    return derived.table(s, d, "events").select(F.col("event_id").alias("ort"), body.alias("antwort"))


Q["read_current"] = lambda s, d: J.read_current(_current(s, d)).drop("symbol", "ist_tag")
SQL["read_current"] = """SELECT event_id AS ort, CASE WHEN leer THEN 'keine Messung in der Nähe' END AS fehler,
CASE WHEN NOT leer THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS zeit, CASE WHEN NOT leer THEN round_even(v / 4, 1) END AS temp,
CASE WHEN NOT leer THEN v END AS wolken, CASE WHEN NOT leer THEN round_even(v / 10, 1) END AS regen, CASE WHEN NOT leer THEN round_even(v / 2, 0) END AS wind,
CASE WHEN NOT leer THEN v END AS boe, CASE WHEN NOT leer THEN v END AS feuchte,
CASE WHEN leer THEN NULL WHEN event_id % 3 = 1 THEN 'Eins' ELSE 'Null' END AS station,
CASE WHEN NOT leer THEN round_even((v * 100 + CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END) / 1000, 1) END AS abstand
FROM (SELECT *, floor(value) AS v, event_id % 13 = 0 AS leer FROM events)"""

# ---- alerts on a stream ------------------------------------------------------------------------------


def _alert_stream(s, d):
    """The forecast written as files, read as a stream, alerts written as files."""
    base = new_folder(s, "alerts")
    fc(s, d).repartitionByRange(4, "zeit").write.parquet(f"{base}/in")
    hours = s.readStream.schema(s.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    query = (stream_alerts(hours, storm=23.0, heavy=5.0).select("ort", "art", "tag").writeStream.format("parquet")
             .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return s.read.parquet(f"{base}/out")


Q["alert_stream"] = _alert_stream
SQL["alert_stream"] = with_fc(f"""SELECT DISTINCT ort, art, {_DAY} AS tag FROM (SELECT ort, zeit, 'sturm' AS art FROM fc WHERE boe >= 23
UNION ALL SELECT ort, zeit, 'regen' FROM fc WHERE regen >= 5 UNION ALL SELECT ort, zeit, 'gewitter' FROM fc WHERE symbol = 'gewitter')""")
