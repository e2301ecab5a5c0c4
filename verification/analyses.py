"""Analyses over whole series and over all stations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from isotherm.operators import national as D, records as R, totals as T, waves as W, yearly as A
from isotherm.plans import views
from isotherm.schema import CATEGORIES, CATEGORY_ORDER, SNAPSHOT, THRESHOLDS
from isotherm.sources import derived
from verification.base import (
    K, LAST, OBS, STATIONS, clean_cte, cleaned, normal_cte, over_c, r, rounded, rs,
)

Q: dict = {}
SQL: dict = {}

# ---- records ------------------------------------------------------------------------------
_CAT = "kat AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{col}', '{dr}', '{title}', '{unit}', {-1.0 if dr == 'hoch' else 1.0}::DOUBLE, {f}::DOUBLE)"
    for i, col, dr, title, unit, f in CATEGORIES) + ") t(nr, spalte, richtung, kategorie, einheit, vz, faktor))"
_LONG = """lang AS (SELECT station, datum, spalte, richtung, kategorie, einheit, vz, faktor, vz * v AS key FROM (
SELECT station, datum, unnest(['tmk','txk','tnk','rsk','fx','sdk','shk','tgk']) AS sp,
unnest([tmk, txk, tnk, rsk, fx, sdk, shk, tgk]) AS v FROM c) JOIN kat ON kat.spalte = sp WHERE v IS NOT NULL)"""
_TOP = f"""SELECT station, spalte, richtung, kategorie, einheit,
rank() OVER (PARTITION BY station, kategorie ORDER BY key) AS platz, datum, {r('key * vz * faktor', 'wert')}, tage
FROM (SELECT *, count(*) OVER (PARTITION BY station, kategorie) AS tage,
      row_number() OVER (PARTITION BY station, kategorie ORDER BY key, datum) AS nr FROM lang) WHERE nr <= 10"""
Q["records"] = lambda s, d: rounded(R.records(cleaned(s, d)))
SQL["records"] = over_c(_TOP, _CAT, _LONG)
_DEPTH = """SELECT station, (max(datum) - min(datum) + 1) / 365.25::DOUBLE AS jahre FROM c GROUP BY station"""
_ALLOW = "CASE WHEN jahre < 10 THEN 1 WHEN jahre < 20 THEN 3 WHEN jahre < 50 THEN 5 ELSE 10 END"
Q["permitted_depth"] = lambda s, d: rounded(R.permitted_depth(cleaned(s, d)))
SQL["permitted_depth"] = over_c(f"SELECT station, {r('jahre', 'jahre')}, {_ALLOW} AS erlaubt FROM ({_DEPTH})")
Q["records_limited"] = lambda s, d: rounded(R.records(cleaned(s, d), limit_depth=True).drop("jahre"))
SQL["records_limited"] = over_c(f"""SELECT t.*, {_ALLOW} AS erlaubt FROM ({_TOP}) t JOIN ({_DEPTH}) USING (station)
WHERE platz <= {_ALLOW}""", _CAT, _LONG)
Q["extremes"] = lambda s, d: rounded(R.extremes(cleaned(s, d)))
SQL["extremes"] = over_c(f"""SELECT station, {r('max(txk)', 'heiss')},
(SELECT min(datum) FROM c x WHERE x.station = c.station AND x.txk = (SELECT max(txk) FROM c y WHERE y.station = c.station)) AS heiss_datum,
{r('min(tnk)', 'kalt')},
(SELECT min(datum) FROM c x WHERE x.station = c.station AND x.tnk = (SELECT min(tnk) FROM c y WHERE y.station = c.station)) AS kalt_datum
FROM c GROUP BY station""")


def _history(target: str, name: str = "tagw") -> str:
    return f"""{name} AS (SELECT station, ziel, year(datum) AS jahr, sp AS spalte, v AS wert FROM (
SELECT c.station, {target} AS ziel, datum, unnest(['tmk','txk','tnk']) AS sp, unnest([tmk, txk, tnk]) AS v
FROM c JOIN letzt USING (station) WHERE month(datum) = month({target}) AND day(datum) = day({target}))
WHERE v IS NOT NULL)"""


_THIS_DAY = f"""SELECT h.station, ziel AS datum, h.spalte,
{r("max(CASE WHEN jahr = year(ziel) THEN wert END)", "wert")},
max(CASE WHEN jahr = year(ziel) THEN rw END) AS platz_warm, max(CASE WHEN jahr = year(ziel) THEN rk END) AS platz_kalt,
count(*) AS von, {', '.join(r(f"max(CASE WHEN {s[0]} = {i} THEN wert END)", f"{n}{i}_wert") + f", max(CASE WHEN {s[0]} = {i} THEN jahr END) AS {n}{i}_jahr" for n, s in (("warm", ("nw",)), ("kalt", ("nk",))) for i in (1, 2, 3))},
{r('max(n.mittel)', 'normal')}
FROM (SELECT *, rank() OVER (PARTITION BY station, spalte ORDER BY wert DESC) AS rw,
 rank() OVER (PARTITION BY station, spalte ORDER BY wert) AS rk,
 row_number() OVER (PARTITION BY station, spalte ORDER BY wert DESC, jahr) AS nw,
 row_number() OVER (PARTITION BY station, spalte ORDER BY wert, jahr) AS nk FROM tagw) h
LEFT JOIN (SELECT 'tmk' AS sp, * FROM n1 UNION ALL SELECT 'txk', * FROM n2 UNION ALL SELECT 'tnk', * FROM n3) n
 ON n.station = h.station AND n.sp = h.spalte AND n.k = {K('ziel')} GROUP BY h.station, ziel, h.spalte"""
_N3 = [normal_cte(c, f"n{i}") for i, c in ((1, "tmk"), (2, "txk"), (3, "tnk"))]
Q["on_this_day"] = lambda s, d: rounded(R.on_this_day(cleaned(s, d)))
SQL["on_this_day"] = over_c(_THIS_DAY, LAST, _history("letzter"), *_N3)
_LEAP = dt.date(2000, 2, 29)
Q["on_leap_day"] = lambda s, d: rounded(R.on_this_day(cleaned(s, d), _LEAP))
SQL["on_leap_day"] = over_c(_THIS_DAY, LAST, _history("DATE '2000-02-29'"), *_N3)
Q["this_day_years"] = lambda s, d: rounded(R.this_day_years(cleaned(s, d)))
SQL["this_day_years"] = over_c(f"""SELECT station, jahr, {r("max(wert) FILTER (spalte = 'tmk')", 'tmk')},
{r("max(wert) FILTER (spalte = 'txk')", 'txk')}, {r("max(wert) FILTER (spalte = 'tnk')", 'tnk')}
FROM tagw GROUP BY station, jahr""", LAST, _history("letzter"))

# ---- per year --------------------------------------------------------------------------------
_MEAS = {"txk": "tage_x", "tnk": "tage_n", "tgk": "tage_g"}
Q["threshold_days"] = lambda s, d: rounded(A.threshold_days(cleaned(s, d)))
SQL["threshold_days"] = over_c(f"""SELECT *, {', '.join(r(f"avg(CASE WHEN jahr BETWEEN 1991 AND 2020 AND {_MEAS[c]} >= 330 THEN {n} END) OVER (PARTITION BY station)", f"normal_{n}") for n, (c, o, v) in THRESHOLDS.items())}
FROM (SELECT station, year(datum) AS jahr, {', '.join(f'count(*) FILTER ({c} {o} {v}) AS {n}' for n, (c, o, v) in THRESHOLDS.items())},
count(txk) AS tage_x, count(tnk) AS tage_n, count(tgk) AS tage_g FROM c GROUP BY ALL)""")
_STRIPES = f"""SELECT station, jahr, {r('m', 'm')}, {r('m - b', 'abw')}, {r('b', 'bezug')}, bezug_jahre FROM (
SELECT *, avg(CASE WHEN jahr BETWEEN 1991 AND 2020 THEN m END) OVER (PARTITION BY station) AS b,
count(CASE WHEN jahr BETWEEN 1991 AND 2020 THEN 1 END) OVER (PARTITION BY station) AS bezug_jahre FROM (
SELECT station, year(datum) AS jahr, avg(tmk) AS m FROM c WHERE tmk IS NOT NULL GROUP BY ALL
HAVING count(*) >= {{n}}))"""
Q["stripes"] = lambda s, d: rounded(A.stripes(cleaned(s, d)))
SQL["stripes"] = over_c(_STRIPES.format(n=330))
Q["snow_winters"] = lambda s, d: rounded(A.snow_winters(cleaned(s, d)))
SQL["snow_winters"] = over_c(f"""SELECT w.station, w.winter, tage, schneetage, {r('mx', 'max')},
(SELECT min(datum) FROM wt x WHERE x.station = w.station AND x.winter = w.winter AND x.shk = mx) AS max_datum, erster, letzter,
{r('avg(CASE WHEN winter BETWEEN 1991 AND 2020 AND tage >= 0.9 * 212 THEN schneetage END) OVER (PARTITION BY station)', 'normal')}
FROM (SELECT station, winter, count(shk) AS tage, count(*) FILTER (shk >= 1) AS schneetage, max(shk) AS mx,
min(datum) FILTER (shk >= 1) AS erster, max(datum) FILTER (shk >= 1) AS letzter FROM wt GROUP BY ALL) w""",
    """wt AS (SELECT *, year(datum) + CASE WHEN month(datum) >= 10 THEN 1 ELSE 0 END AS winter FROM c
WHERE month(datum) NOT BETWEEN 5 AND 9)""")
Q["wind_years"] = lambda s, d: rounded(A.wind_years(cleaned(s, d)))
SQL["wind_years"] = over_c(f"""SELECT station, jahr, tage, sturm, orkan, {r('mx * 3.6::DOUBLE', 'max')},
(SELECT min(datum) FROM c x WHERE x.station = w.station AND year(x.datum) = w.jahr AND x.fx = mx) AS max_datum,
tage < 330 AS unvollstaendig,
{r('avg(CASE WHEN jahr BETWEEN 1991 AND 2020 AND tage >= 330 THEN sturm END) OVER (PARTITION BY station)', 'normal')}
FROM (SELECT station, year(datum) AS jahr, count(fx) AS tage, count(*) FILTER (fx >= 75 / 3.6::DOUBLE) AS sturm,
count(*) FILTER (fx >= 118 / 3.6::DOUBLE) AS orkan, max(fx) AS mx FROM c GROUP BY ALL) w""")


def _frost(name, col):
    return (f"max(datum) FILTER ({col} < 0 AND month(datum) <= 6) AS {name}_letzter, "
            f"min(datum) FILTER ({col} < 0 AND month(datum) >= 7) AS {name}_erster, count({col}) AS {name}_tage")


Q["frost_years"] = lambda s, d: rounded(A.frost_years(cleaned(s, d)))
SQL["frost_years"] = over_c(f"""SELECT *, {', '.join(r(f"avg(CASE WHEN jahr BETWEEN 1991 AND 2020 AND {n}_tage >= 330 THEN {n}_frei END) OVER (PARTITION BY station)", f"normal_{n}_frei") for n in ("luft", "boden"))}
FROM (SELECT *, luft_erster - luft_letzter - 1 AS luft_frei, boden_erster - boden_letzter - 1 AS boden_frei FROM (
SELECT station, year(datum) AS jahr, {_frost('luft', 'tnk')}, {_frost('boden', 'tgk')} FROM c GROUP BY ALL)
WHERE luft_tage > 0 OR boden_tage > 0)""")

# ---- waves and dry spells ------------------------------------------------------------------------


def _runs(name: str, typ: str, value: str, extreme: str, condition: str, shortest: int, src: str = "c") -> str:
    return f"""{name} AS (SELECT station, '{typ}' AS typ, min(datum) AS von, max(datum) AS bis, count(*) AS tage,
{extreme}({value}) AS extrem, avg({value}) AS mittel FROM (SELECT *, datum - CAST(row_number() OVER
(PARTITION BY station ORDER BY datum) AS INTEGER) AS insel FROM {src} WHERE {condition})
GROUP BY station, insel HAVING count(*) >= {shortest})"""


_BOTH = "wellen AS (SELECT * FROM w1 UNION ALL SELECT * FROM w2)"


def _fixed(hot, cold, n):
    return [_runs("w1", "hitze", "txk", "max", f"txk >= {hot}", n),
            _runs("w2", "kaelte", "txk", "min", f"txk < {cold}", n), _BOTH]


_NORMAL = [normal_cte("tmk", "n"), f"cn AS (SELECT c.*, p10, p90 FROM c JOIN n ON n.station = c.station AND n.k = {K()})",
           _runs("w1", "hitze", "tmk", "max", "tmk > p90", 5, "cn"),
           _runs("w2", "kaelte", "tmk", "min", "tmk < p10", 5, "cn"), _BOTH]
_LIST = f"SELECT station, typ, von, bis, tage, {rs('extrem', 'mittel')} FROM wellen"
_WYEARS = """SELECT station, year(von) AS jahr, """ + ", ".join(
    f"count(*) FILTER (typ = '{t}') AS {t}, coalesce(sum(tage) FILTER (typ = '{t}'), 0) AS {t}_tage, "
    f"coalesce(max(tage) FILTER (typ = '{t}'), 0) AS {t}_laengste" for t in ("hitze", "kaelte")
) + " FROM wellen GROUP BY ALL"
_LONGEST = f"""SELECT station, typ, von, bis, tage, {rs('extrem', 'mittel')}, nr FROM (SELECT *, row_number() OVER
(PARTITION BY station, typ ORDER BY tage DESC, von) AS nr FROM wellen) WHERE nr <= 10"""
Q["waves_fixed"] = lambda s, d: rounded(W.waves(cleaned(s, d), "fest"))
SQL["waves_fixed"] = over_c(_LIST, *_fixed(30, 0, 3))
Q["waves_own"] = lambda s, d: rounded(W.waves(cleaned(s, d), "eigen", 20, 25, 2))
SQL["waves_own"] = over_c(_LIST, *_fixed(20, 25, 2))
# eight days far off in two years: runs beyond the normals, which the plain series has none of
_SHIFT = "CASE WHEN month(datum) IN (3, 8) AND day(datum) BETWEEN 5 AND 12 THEN CASE year(datum) WHEN 1996 THEN 30 WHEN 1997 THEN -30 ELSE 0 END ELSE 0 END"
Q["waves_normal"] = lambda s, d: rounded(W.waves(cleaned(s, d).withColumn("tmk", F.expr(f"tmk + {_SHIFT}")), "normal"))
SQL["waves_normal"] = "WITH " + ",\n".join([OBS, clean_cte(0, "roh"), f"c AS (SELECT * REPLACE (tmk + {_SHIFT} AS tmk) FROM roh)", *_NORMAL]) + "\n" + _LIST
Q["wave_years"] = lambda s, d: rounded(W.wave_years(W.waves(cleaned(s, d), "fest")))
SQL["wave_years"] = over_c(_WYEARS, *_fixed(30, 0, 3))
Q["wave_years_own"] = lambda s, d: W.wave_years(W.waves(cleaned(s, d), "eigen", 10, 35, 1))
SQL["wave_years_own"] = over_c(_WYEARS, *_fixed(10, 35, 1))
Q["longest_waves"] = lambda s, d: rounded(W.longest_waves(W.waves(cleaned(s, d), "fest")))
SQL["longest_waves"] = over_c(_LONGEST, *_fixed(30, 0, 3))
_DRY = [_runs("tr", "t", "rsk", "max", "rsk < 0.1::DOUBLE", 1), """trl AS (
SELECT station, jahr, von, CAST(least(bis, make_date(jahr, 12, 31)) - von + 1 AS INTEGER) AS l FROM
(SELECT station, von, bis, unnest(range(year(von), year(bis) + 1)) AS jahr FROM tr))""",
        """trj AS (SELECT station, jahr, l AS trocken, von AS trocken_von FROM trl QUALIFY row_number() OVER
(PARTITION BY station, jahr ORDER BY l DESC, von) = 1)""",
        """trocken AS (SELECT station, jahr, coalesce(trocken, 0) AS trocken, trocken_von FROM
(SELECT DISTINCT station, year(datum) AS jahr FROM c) LEFT JOIN trj USING (station, jahr))"""]
Q["dry_spells"] = lambda s, d: W.dry_spells(cleaned(s, d))
SQL["dry_spells"] = over_c("SELECT * FROM trocken", *_DRY)

# ---- totals -------------------------------------------------------------------------------------------


def _totals(col: str) -> str:
    return f"""tot AS (SELECT station, jahr, summe, tage, {'nass' if col == 'rsk' else 'NULL::BIGINT'} AS nass, mx AS max,
(SELECT min(datum) FROM c x WHERE x.station = w.station AND year(x.datum) = w.jahr AND x.{col} = mx) AS max_datum
FROM (SELECT station, year(datum) AS jahr, coalesce(sum({col}), 0) AS summe, count({col}) AS tage,
count(*) FILTER ({col} >= 0.1::DOUBLE) AS nass, max({col}) AS mx FROM c GROUP BY ALL) w)"""


def _rank(col: str) -> str:
    return f"""rang AS (SELECT station, jahr, summe, tage, row_number() OVER (PARTITION BY station ORDER BY
{r('summe', digits=1)} DESC, jahr) AS platz,
avg(CASE WHEN jahr BETWEEN 1991 AND 2020 THEN summe END) OVER (PARTITION BY station) AS normal,
count(CASE WHEN jahr BETWEEN 1991 AND 2020 THEN 1 END) OVER (PARTITION BY station) AS normal_jahre
FROM (SELECT station, year(datum) AS jahr, sum({col}) AS summe, count(*) AS tage FROM c
WHERE {col} IS NOT NULL GROUP BY ALL HAVING count(*) >= 330))"""


_TOT = f"SELECT station, jahr, {r('summe', 'summe')}, tage, nass, {r('max', 'max')}, max_datum, "
Q["rain_totals"] = lambda s, d: rounded(T.yearly_totals(cleaned(s, d), "rsk"))
SQL["rain_totals"] = over_c(_TOT + "trocken, trocken_von FROM tot JOIN trocken USING (station, jahr)",
                            _totals("rsk"), *_DRY)
Q["sun_totals"] = lambda s, d: rounded(T.yearly_totals(cleaned(s, d), "sdk"))
SQL["sun_totals"] = over_c(_TOT + "NULL::INTEGER AS trocken, NULL::DATE AS trocken_von FROM tot", _totals("sdk"))
_RANK = f"SELECT station, jahr, {r('summe', 'summe')}, tage, platz, {r('normal', 'normal')}, normal_jahre FROM rang"
Q["rain_rank"] = lambda s, d: rounded(T.totals_rank(cleaned(s, d), "rsk"))
SQL["rain_rank"] = over_c(_RANK, _rank("rsk"))
Q["sun_rank"] = lambda s, d: rounded(T.totals_rank(cleaned(s, d), "sdk"))
SQL["sun_rank"] = over_c(_RANK, _rank("sdk"))


def _curves(col: str) -> list[str]:
    return [f"""tw AS (SELECT station, year(datum) AS jahr, {K()} AS k, {col} AS v FROM c WHERE {col} IS NOT NULL)""",
            """kurve AS (SELECT g.station, g.jahr, g.k, sum(coalesce(v, 0)) OVER (PARTITION BY g.station, g.jahr
ORDER BY g.k) AS kumuliert FROM (SELECT *, unnest(range(0, 366)) AS k FROM (SELECT DISTINCT station, jahr FROM tw)) g
LEFT JOIN tw USING (station, jahr, k))""",
            f"""lk AS (SELECT tw.station, tw.jahr, max(k) AS k FROM tw JOIN (SELECT station, year(max(datum)) AS jahr
FROM c WHERE {col} IS NOT NULL GROUP BY station) USING (station, jahr) GROUP BY ALL)""",
            """band AS (SELECT station, k, quantile_cont(kumuliert, 0.1) AS p10, quantile_cont(kumuliert, 0.5) AS p50,
quantile_cont(kumuliert, 0.9) AS p90, count(*) AS jahre FROM kurve JOIN (SELECT station, jahr FROM tw
WHERE jahr BETWEEN 1991 AND 2020 GROUP BY ALL HAVING count(*) >= 330) USING (station, jahr) GROUP BY ALL)"""]


Q["rain_curve"] = lambda s, d: rounded(T.cumulative(cleaned(s, d), "rsk"))
SQL["rain_curve"] = over_c(f"""SELECT station, jahr, kurve.k, {r('kumuliert', 'kumuliert')} FROM kurve
JOIN lk USING (station, jahr) WHERE kurve.k <= lk.k""", *_curves("rsk"))
Q["rain_band"] = lambda s, d: rounded(T.cumulative_band(cleaned(s, d), "rsk"))
SQL["rain_band"] = over_c(f"SELECT station, k, {rs('p10', 'p50', 'p90')}, jahre FROM band", *_curves("rsk"))


def _months(col: str, year: str) -> str:
    return over_c(f"""SELECT j.station, j.monat, j.jahr, {r('j.s', 'summe')}, j.n AS tage, {r('u.normal', 'normal')} FROM
(SELECT c.station, year(datum) AS jahr, month(datum) AS monat, sum({col}) AS s, count(*) AS n FROM c
 JOIN (SELECT station, {year} AS z FROM c WHERE {col} IS NOT NULL GROUP BY station) USING (station)
 WHERE {col} IS NOT NULL AND year(datum) = z GROUP BY ALL) j
LEFT JOIN (SELECT station, monat, avg(s) AS normal FROM (SELECT station, year(datum) AS jahr, month(datum) AS monat,
 sum({col}) AS s FROM c WHERE {col} IS NOT NULL AND year(datum) BETWEEN 1991 AND 2020 GROUP BY ALL
 HAVING count(*) >= 0.9 * day(last_day(min(datum)))) GROUP BY ALL) u USING (station, monat)""")


Q["rain_months"] = lambda s, d: rounded(T.monthly_totals(cleaned(s, d), "rsk"))
SQL["rain_months"] = _months("rsk", "year(max(datum))")
Q["sun_months_1996"] = lambda s, d: rounded(T.monthly_totals(cleaned(s, d), "sdk", 1996))
SQL["sun_months_1996"] = _months("sdk", "1996")
Q["totals_summary"] = lambda s, d: rounded(views.totals_summary(cleaned(s, d), "rsk"))
SQL["totals_summary"] = over_c(f"""SELECT t.station, t.jahr, {r('t.summe', 'summe')}, t.tage, nass, {r('max', 'max')}, max_datum,
trocken, trocken_von, rg.platz, {r('u.normal', 'normal')}, u.normal_jahre, lk.k, {r('kurve.kumuliert', 'stand')},
{r('band.p10', 'p10')}, {r('band.p50', 'p50')}, {r('band.p90', 'p90')}
FROM tot t JOIN trocken USING (station, jahr) LEFT JOIN rang rg ON rg.station = t.station AND rg.jahr = t.jahr
LEFT JOIN (SELECT DISTINCT station, normal, normal_jahre FROM rang) u ON u.station = t.station
LEFT JOIN lk ON lk.station = t.station AND lk.jahr = t.jahr
LEFT JOIN kurve ON kurve.station = t.station AND kurve.jahr = t.jahr AND kurve.k = lk.k
LEFT JOIN band ON band.station = t.station AND band.k = lk.k""", _totals("rsk"), *_DRY, _rank("rsk"), *_curves("rsk"))

# ---- all stations --------------------------------------------------------------------------------------
_SNAP = [STATIONS, "stand AS (SELECT max(datum) AS stand FROM c)", f"""snap AS (
SELECT g.station, g.datum, u.spalte, name, land, hoehe, {r('u.wert', 'wert', 1)} FROM (SELECT station, unnest(generate_series(stand - 6, stand, INTERVAL 1 DAY))::DATE AS datum
 FROM (SELECT DISTINCT station FROM c, stand WHERE datum >= stand - 6), stand) g
CROSS JOIN (SELECT unnest([{', '.join(f"'{m}'" for m in SNAPSHOT)}]) AS spalte) sp
LEFT JOIN (SELECT station, datum, unnest([{', '.join(f"'{m}'" for m in SNAPSHOT)}]) AS spalte, unnest([{', '.join(SNAPSHOT)}]) AS wert FROM c) u
 ON u.station = g.station AND u.datum = g.datum AND u.spalte = sp.spalte
LEFT JOIN st ON st.id = g.station)""".replace("u.spalte, name", "sp.spalte, name")]


def _snapshot(s, d):
    return D.national_snapshot(cleaned(s, d), derived.stations(s, d))


Q["national_snapshot"] = _snapshot
SQL["national_snapshot"] = over_c("SELECT * FROM snap", *_SNAP)
_SHOWN = "CASE spalte " + " ".join(
    f"WHEN '{m}' THEN floor(wert * {f}::DOUBLE * {10 ** g} + 0.5) / {10 ** g}::DOUBLE" for m, (f, g) in D.SHOWN.items()) + " END"


def _top(direction: str, where: str, n: int) -> str:
    o = "DESC" if direction == "hoch" else ""
    return over_c(f"""SELECT datum, spalte, rank() OVER (PARTITION BY datum, spalte ORDER BY wert {o}) AS platz,
station, name, land, hoehe, wert FROM (SELECT * REPLACE ({_SHOWN} AS wert) FROM snap WHERE wert IS NOT NULL AND {where})
QUALIFY row_number() OVER (PARTITION BY datum, spalte ORDER BY wert {o}, name, station) <= {n}""", *_SNAP)


Q["top_stations_high"] = lambda s, d: D.top_stations(_snapshot(s, d), n=3)
SQL["top_stations_high"] = _top("hoch", "true", 3)
Q["top_stations_low_below1000"] = lambda s, d: D.top_stations(_snapshot(s, d), direction="tief", height="u1000")
SQL["top_stations_low_below1000"] = _top("tief", "hoehe < 1000", 50)
Q["station_count"] = lambda s, d: D.station_count(_snapshot(s, d), height="a1500")
SQL["station_count"] = over_c("""SELECT datum, spalte, count(*) FILTER (wert IS NOT NULL AND hoehe >= 1500) AS anzahl
FROM snap GROUP BY ALL""", *_SNAP)

_PERMIT = "CASE WHEN jahre < 3 THEN 0 WHEN jahre < 20 THEN 1 WHEN jahre < 30 THEN 3 WHEN jahre < 50 THEN 5 ELSE 10 END"
_NEW = [_CAT, _LONG, "stand AS (SELECT max(datum) AS stand FROM c)", f"""neu AS (
SELECT station, datum, spalte, richtung, kategorie, einheit, key * vz * faktor AS wert, platz, {_PERMIT} AS von,
 year(erster) AS seit, jahre, bk * vz * faktor AS bisher_wert, bd AS bisher_datum FROM (
SELECT w.*, f.erster, (w.datum - f.erster + 1) / 365.25::DOUBLE AS jahre,
 1 + count(*) FILTER (e.key <= w.key) AS platz, min(e.key) AS bk, arg_min(e.datum, (e.key, e.datum)) AS bd
FROM (SELECT lang.* FROM lang, stand WHERE datum >= stand - {{days}} + 1) w
JOIN (SELECT station, kategorie, min(datum) AS erster FROM lang GROUP BY ALL) f
 ON f.station = w.station AND f.kategorie = w.kategorie
LEFT JOIN lang e ON e.station = w.station AND e.kategorie = w.kategorie AND e.datum < w.datum
GROUP BY ALL) WHERE platz <= {_PERMIT})"""]
_NEWCOLS = f"""station, datum, spalte, richtung, kategorie, einheit, {r('wert', 'wert')}, platz, von, seit,
{r('jahre', 'jahre')}, {r('bisher_wert', 'bisher_wert')}, bisher_datum"""


def _new(days: int) -> list[str]:
    return [x.replace("{days}", str(days)) for x in _NEW]


Q["new_records"] = lambda s, d: rounded(D.new_records(cleaned(s, d)))
SQL["new_records"] = over_c(f"SELECT {_NEWCOLS} FROM neu", *_new(365))
Q["new_records_long_window"] = lambda s, d: rounded(D.new_records(cleaned(s, d), 1400))
SQL["new_records_long_window"] = over_c(f"SELECT {_NEWCOLS} FROM neu", *_new(1400))


def _calendar(days: int, years: int) -> list[str]:
    return [_CAT, _LONG, "stand AS (SELECT max(datum) AS stand FROM c)", f"""kt AS (
SELECT * FROM (SELECT station, datum, spalte, richtung, kategorie, einheit, key, vz, faktor,
 count(*) OVER w AS jahre, min(key) OVER w AS bk, first_value(datum) OVER w2 AS egal,
 arg_min(datum, (key, datum)) OVER w AS bd
FROM lang WINDOW w AS (PARTITION BY station, kategorie, month(datum), day(datum) ORDER BY datum
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY station ORDER BY datum)), stand
WHERE datum >= stand - {days} + 1 AND jahre >= {years} AND key < bk)"""]


_KT = f"""SELECT station, datum, spalte, richtung, kategorie, einheit, {r('key * vz * faktor', 'wert')}, jahre,
{r('bk * vz * faktor', 'bisher_wert')}, bd AS bisher_datum FROM kt"""
Q["calendar_day_records"] = lambda s, d: rounded(D.calendar_day_records(cleaned(s, d), 60, 3))
SQL["calendar_day_records"] = over_c(_KT, *_calendar(60, 3))


def _job(s, d):
    parts = views.records_job(cleaned(s, d), derived.stations(s, d), 365, 60, 3)
    a = parts["eintraege"].select("station", "datum", "kategorie", "wert", "platz", "name", "land",
                                  "hoehe", F.lit("rekord").alias("art"))
    b = parts["kalendertag"].select("station", "datum", "kategorie", "wert", F.lit(None).cast("int").alias("platz"),
                                    "name", "land", "hoehe", F.lit("kalendertag").alias("art"))
    return rounded(a.unionByName(b))


Q["records_job"] = _job
SQL["records_job"] = over_c(f"""SELECT station, datum, kategorie, {r('wert', 'wert')}, platz, name, land, hoehe, 'rekord' AS art
FROM neu JOIN st ON st.id = station UNION ALL
SELECT station, datum, kategorie, {r('key * vz * faktor', 'wert')}, NULL, name, land, hoehe, 'kalendertag'
FROM kt JOIN st ON st.id = station""", STATIONS, *_new(365), _calendar(60, 3)[3])
# the same from a state of the ten best that ends years before the window
Q["new_records_state"] = lambda s, d: rounded(D.new_records_from_state(D.best_state(cleaned(s, d), dt.date(1995, 12, 31)), cleaned(s, d), 1400))
SQL["new_records_state"] = SQL["new_records_long_window"]


def _advanced(s, d):
    c = cleaned(s, d)
    state = D.advance_state(D.advance_state(D.best_state(c, dt.date(1993, 5, 31)), c, dt.date(1996, 6, 30)), c, dt.date(1999, 12, 31))
    return rounded(state.select("station", "kat", "erster", F.posexplode("beste").alias("stelle", "b")).select("station", "kat", "erster", "stelle", "b.key", "b.datum"))


Q["best_state"] = _advanced
SQL["best_state"] = over_c(f"""SELECT station, nr AS kat, erster, stelle, {r('key', 'key')}, datum FROM (SELECT lang.*, kat.nr, min(datum) OVER g AS erster,
row_number() OVER (PARTITION BY station, kat.nr ORDER BY key, datum) - 1 AS stelle FROM lang JOIN kat USING (kategorie)
WHERE datum <= DATE '1999-12-31' WINDOW g AS (PARTITION BY station, kat.nr)) WHERE stelle < 10""", _CAT, _LONG)
Q["records_by_day"] = lambda s, d: rounded(D.records_by_day(D.new_records(cleaned(s, d), 1400)).withColumn(
    "reihe", F.array_position(F.array(*[F.lit(k) for k in CATEGORY_ORDER]), F.col("kategorie"))))
SQL["records_by_day"] = over_c(f"""SELECT {_NEWCOLS},
list_position([{', '.join(f"'{k}'" for k in CATEGORY_ORDER)}], kategorie) AS reihe FROM neu""", *_new(1400))


def _recent(s, d):
    c = cleaned(s, d)
    return rounded(D.recent_records(D.new_records(c, 1400), D.newest_day(c), 900))


Q["recent_records"] = _recent
SQL["recent_records"] = over_c(f"SELECT {_NEWCOLS} FROM neu, stand WHERE datum >= stand - 899", *_new(1400))


def _favourites(s, d):
    c = cleaned(s, d)
    favs = derived.stations(s, d).where("hoehe = 300").select(F.col("id").alias("station"))
    return rounded(D.favourite_alerts(D.new_records(c), D.calendar_day_records(c, 60, 3), favs,
                                      since=F.date_sub(D.newest_day(c), 90)))


Q["favourite_alerts"] = _favourites
SQL["favourite_alerts"] = over_c(f"""SELECT station, datum, kategorie, einheit, {r('wert', 'wert')}, 'rekord' AS art, platz, seit,
NULL::BIGINT AS jahre FROM neu, stand WHERE datum > stand - 90 AND platz <= 3 AND station IN (SELECT id FROM st WHERE hoehe = 300)
UNION ALL SELECT station, datum, kategorie, einheit, {r('key * vz * faktor', 'wert')}, 'kalendertag', NULL, NULL, jahre
FROM kt WHERE datum > stand - 90 AND station IN (SELECT id FROM st WHERE hoehe = 300)""",
    STATIONS, *_new(365), _calendar(60, 3)[3])
