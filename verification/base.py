"""Shared pieces of the queries and of the SQL they are checked against."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotherm.operators.clean import clean
from isotherm.sources import derived

TODAY = dt.date(2001, 11, 5)
NOW = dt.datetime(2024, 1, 10, 6, 20)
COMPARE_YEARS = 5


NUDGE = 1e-10       # off the halves, where the two engines round differently


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that summation noise does not show."""
    return df.select(*[
        F.round(F.col(f.name) + NUDGE, 6).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields])


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """The same in SQL; with fewer digits the rounding for display."""
    value = f"CAST({expression} AS DOUBLE)"
    out = f"round({value} + {NUDGE}::DOUBLE, 6)" if digits == 6 else f"round(round({value}, 9), {digits})"
    return out + (f" AS {name}" if name else "")


def rs(*names: str) -> str:
    return ", ".join(r(n, n.split(".")[-1]) for n in names)


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return derived.observations(spark, sf)


def cleaned(spark: SparkSession, sf: str, level: str = "alle") -> DataFrame:
    return clean(derived.observations(spark, sf), level)


OBS = """obs AS (
SELECT station, datum,
       CASE WHEN md = 518 THEN q_max + 1 ELSE q_avg END - 10 AS tmk,
       CASE WHEN md = 519 THEN 71 WHEN md = 517 THEN q_min - 1 ELSE q_max END - 10 AS txk,
       q_min - 10 AS tnk,
       CASE WHEN day(datum) % 10 = 0 THEN 1 WHEN year(datum) < 1998 THEN 5 ELSE 10 END AS qn,
       CASE WHEN datum <= DATE '2000-12-31' THEN 0 ELSE 1 END AS quelle,
       p_max / 2500 + CASE WHEN md = 613 THEN 60 ELSE 0 END AS fx,
       p_avg / 2500 + CASE WHEN md = 614 THEN 50 ELSE 0 END AS fm,
       d_min * 100 AS rsk, ln_min AS rskf, t_avg * 210 AS sdk, floor(q_min / 10) AS shk,
       d_min * 90 AS nm, q_avg / 2 AS vpm, 990 + q_avg / 2 AS pm, 2.05::DOUBLE * q_max AS upm,
       q_min - 12 AS tgk, CASE WHEN day(datum) % 7 = 0 THEN 3 ELSE 10 END AS qn3
FROM (SELECT CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 20 ELSE 30 END
             + CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS station,
             CAST(l_shipdate AS DATE) AS datum,
             month(l_shipdate) * 100 + day(l_shipdate) AS md,
             avg(l_quantity) q_avg, max(l_quantity) q_max, min(l_quantity) q_min,
             max(l_extendedprice) p_max, avg(l_extendedprice) p_avg,
             min(l_discount) d_min, avg(l_tax) t_avg, min(l_linenumber) ln_min
      FROM lineitem GROUP BY ALL) g)"""


# cleaning as tables of rules over a long form: limits per measure, and pairs of which the upper
# one must not lie below the lower one, with what such a day loses
_MEASURED = ["tmk", "txk", "tnk", "fx", "fm", "rsk", "sdk", "shk", "nm", "vpm", "pm", "upm", "tgk"]
_LIMIT_ROWS = """('tmk', -45, 50), ('txk', -45, 50), ('tnk', -45, 50), ('fx', 0, 250 / 3.6::DOUBLE), ('fm', 0, 250 / 3.6::DOUBLE),
 ('rsk', 0, 300), ('sdk', 0, 16.5), ('shk', 0, 800), ('nm', 0, 8), ('vpm', 0, 125), ('pm', 500, 1100), ('upm', 0, 100), ('tgk', -50, 50)"""
_ORDER_ROWS = """('txk', 'tnk', ['tmk', 'txk', 'tnk']), ('tmk', 'tnk', ['tmk']), ('txk', 'tmk', ['tmk']), ('fx', 'fm', ['fm'])"""


def clean_cte(level: int = 0, name: str = "c") -> str:
    entries = ", ".join(f"{{'s': '{m}', 'w': {m}::DOUBLE, 'q': {'qn3' if m in ('fx', 'fm') else 'qn'}}}" for m in _MEASURED)
    back = ", ".join(f"max(g.w) FILTER (g.s = '{m}') AS {m}" for m in _MEASURED)
    return f"""{name}_lang AS (SELECT station, datum, u.s AS s, u.w AS w FROM (SELECT station, datum, unnest([{entries}]) AS u FROM obs)
WHERE u.w IS NOT NULL AND coalesce(u.q, 0) >= {level}),
{name}_gut AS (SELECT l.station, l.datum, l.s, l.w FROM {name}_lang l JOIN (VALUES {_LIMIT_ROWS}) r(s, lo, hi)
ON r.s = l.s AND l.w BETWEEN r.lo::DOUBLE AND r.hi::DOUBLE),
{name}_weg AS (SELECT DISTINCT o.station, o.datum, unnest(r.opfer) AS s FROM {name}_gut o JOIN {name}_gut u USING (station, datum)
JOIN (VALUES {_ORDER_ROWS}) r(oben, unten, opfer) ON o.s = r.oben AND u.s = r.unten AND o.w < u.w),
{name} AS (SELECT o.station, o.datum, o.qn, o.quelle, {back},
max(CASE WHEN list_contains([0, 1, 4, 6, 7, 8, 9], o.rskf) AND coalesce(o.qn, 0) >= {level} THEN o.rskf END) AS rskf
FROM obs o LEFT JOIN (SELECT * FROM {name}_gut ANTI JOIN {name}_weg USING (station, datum, s)) g USING (station, datum)
GROUP BY o.station, o.datum, o.qn, o.quelle)"""


def K(d: str = "datum") -> str:
    return f"(dayofyear(make_date(2000, month({d}), day({d}))) - 1)"


def MD(d: str = "datum") -> str:
    return f"(month({d}) * 100 + day({d}))"


def over_c(select: str, *ctes: str, level: int = 0) -> str:
    """SQL over the cleaned days (tables obs and c), with further tables."""
    return "WITH " + ",\n".join([OBS, clean_cte(level), *ctes]) + "\n" + select


def over_obs(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([OBS, *ctes]) + "\n" + select


LAST = """letzt AS (SELECT station, max(datum) AS letzter, year(max(datum)) AS jl
FROM c WHERE tmk IS NOT NULL GROUP BY station)"""


def normal_cte(column: str, name: str, lo: int = 1991) -> str:
    """Calendar-day normal of one measure: every target day takes the days at most a week away."""
    return f"""{name} AS (SELECT w.station, z.k, avg(w.v) AS mittel, quantile_cont(w.v, 0.1) AS p10, quantile_cont(w.v, 0.9) AS p90
FROM (SELECT range AS k FROM range(366)) z JOIN (SELECT station, {K()} AS k, {column} AS v FROM c
WHERE {column} IS NOT NULL AND datum BETWEEN DATE '{lo}-01-01' AND DATE '{lo + 29}-12-31') w
ON abs(w.k - z.k) <= 7 OR abs(w.k - z.k) >= 359 GROUP BY w.station, z.k)"""


STATIONS = """st AS (SELECT CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 20 ELSE 30 END
       + CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS id,
       'Station ' || l_returnflag || l_linestatus AS name, l_returnflag AS land,
       CASE l_linestatus WHEN 'F' THEN 300 ELSE 1600 END AS hoehe,
       CASE l_returnflag WHEN 'A' THEN 48.0 WHEN 'N' THEN 51.0 ELSE 53.5 END::DOUBLE AS lat,
       CASE l_linestatus WHEN 'F' THEN 8.0 ELSE 12.0 END::DOUBLE AS lon,
       CAST(min(l_shipdate) AS DATE) AS von, CAST(max(l_shipdate) AS DATE) AS bis
FROM lineitem GROUP BY l_returnflag, l_linestatus)"""

SUPPLIERS = """sst AS (SELECT s_suppkey AS id, s_name AS name, 'Land ' || s_nationkey AS land,
       s_suppkey * 13 % 2000 AS hoehe,
       CASE WHEN s_suppkey % 17 <> 0 THEN 47.5::DOUBLE + (s_suppkey * 29 % 700) / 100.0::DOUBLE END AS lat,
       6.5::DOUBLE + (s_suppkey * 61 % 800) / 100.0::DOUBLE AS lon,
       make_date(1900 + s_suppkey * 11 % 90, 1, 1) AS von,
       make_date(CASE WHEN s_suppkey % 5 = 0 THEN 1999 ELSE 2001 END, 11, 4) AS bis
FROM supplier)"""

PLACES = """pl AS (SELECT c_custkey AS id, c_name AS name,
       47.5::DOUBLE + (c_custkey * 37 % 700) / 100.0::DOUBLE AS lat,
       6.5::DOUBLE + (c_custkey * 53 % 800) / 100.0::DOUBLE AS lon,
       c_custkey * 7 % 2500 AS hoehe, floor(abs(c_acctbal)) AS einwohner,
       c_custkey % 9 = 0 AS gipfel
FROM customer)"""

FORECAST = """fc AS (SELECT CAST(user_id % 3 + 1 AS INTEGER) AS ort, event_type AS modell, zeit, avg(value) / 10 AS temp,
       CASE WHEN count(*) % 7 <> 0 THEN avg(value) % 100 END AS wolken,
       min(value) / 10 AS regen, avg(value) / 5 AS wind, max(value) / 4 AS boe,
       ['klar','heiter','wolkig','bedeckt','nebel','niesel','regen','starkregen','schauer',
        'schneeregen','schnee','schneeschauer','gewitter','glatteis','wind'][max(user_id % 15) + 1] AS symbol,
       CASE max(user_id % 15) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ist_tag,
       CASE WHEN count(*) % 4 <> 0 THEN max(value) % 101 END AS wkt
FROM (SELECT *, date_trunc('hour', ts) AS zeit FROM events) GROUP BY user_id % 3, event_type, zeit)"""

# Berlin time of a UTC timestamp in the winter half the forecast rows lie in
LOCAL = "(zeit + INTERVAL 1 HOUR)"


def hav(a: str, b: str, c: str, d: str) -> str:
    return (f"(2 * 6371 * asin(sqrt(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * "
            f"cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))")
