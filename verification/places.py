"""Geography, search, radar, city layer."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from isotherm.functions.sky import GRID_COLUMNS, GRID_ROWS, RAIN_CLASSES, with_grid, with_lonlat
from isotherm.operators import geo as G, radar as B, search as X
from isotherm.operators.series import station_overview
from isotherm.sources import derived, gazetteer as Z
from isotherm.sources.frames import read_frames
from verification.base import PLACES, STATIONS, SUPPLIERS, OBS, hav, r, rounded, rs

Q: dict = {}
SQL: dict = {}
YEAR = 2002


def pl(s, d):
    return derived.places(s, d)


def st(s, d):
    return derived.supplier_stations(s, d)


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# ---- distance and nearest ---------------------------------------------------------
def _pairs(s, d):
    orders = derived.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("punkt"))
    pairs = derived.table(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("int").alias("station")).join(orders, "l_orderkey").select(
        "punkt", "station").distinct()
    return rounded(G.pair_distances(pairs, pl(s, d), st(s, d)))


Q["pair_distances"] = _pairs
SQL["pair_distances"] = sql(f"""SELECT punkt, station, {r(hav('pl.lat', 'pl.lon', 'sst.lat', 'sst.lon'), 'km')}
FROM (SELECT DISTINCT o_custkey AS punkt, l_suppkey AS station FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
JOIN pl ON pl.id = punkt JOIN sst ON sst.id = station""", PLACES, SUPPLIERS)
_NEAR = f"""SELECT punkt, station, {r('km', 'km')} FROM (SELECT pl.id AS punkt, sst.id AS station, {hav('pl.lat', 'pl.lon', 'sst.lat', 'sst.lon')} AS km
FROM pl, sst WHERE sst.lat IS NOT NULL AND {{where}}) QUALIFY row_number() OVER (PARTITION BY punkt ORDER BY km, station) = 1"""
Q["nearest_station"] = lambda s, d: rounded(G.nearest_station(pl(s, d), st(s, d), True, YEAR))
SQL["nearest_station"] = sql(_NEAR.format(where=f"year(sst.bis) >= {YEAR - 1}"), PLACES, SUPPLIERS)
Q["nearest_station_any"] = lambda s, d: rounded(G.nearest_station(pl(s, d), st(s, d), False))
SQL["nearest_station_any"] = sql(_NEAR.format(where="true"), PLACES, SUPPLIERS)
_SUIT = f"""SELECT punkt, nr, station, {rs('km')}, dh, {r('wert', 'wert')} FROM (SELECT *, row_number() OVER (PARTITION BY punkt ORDER BY wert, station) AS nr
FROM (SELECT punkt, station, km, dh, km + coalesce(abs(dh) / 10.0::DOUBLE, 0) AS wert FROM (SELECT pl.id AS punkt, sst.id AS station,
{hav('pl.lat', 'pl.lon', 'sst.lat', 'sst.lon')} AS km, {{dh}} AS dh FROM pl, sst WHERE sst.lat IS NOT NULL AND year(sst.bis) >= {YEAR - 1}
AND year(sst.bis) - year(sst.von) + 1 >= 30))) WHERE nr <= 3"""
Q["suitable_stations"] = lambda s, d: rounded(G.suitable_stations(pl(s, d), st(s, d), 3, YEAR))
SQL["suitable_stations"] = sql(_SUIT.format(dh="sst.hoehe - pl.hoehe"), PLACES, SUPPLIERS)
Q["suitable_stations_no_height"] = lambda s, d: rounded(G.suitable_stations(
    pl(s, d).withColumn("hoehe", F.lit(None).cast("int")), st(s, d), 3, YEAR))
SQL["suitable_stations_no_height"] = sql(_SUIT.format(dh="NULL::INTEGER"), PLACES, SUPPLIERS)


def _points(s, d):
    key = F.col("s_suppkey")
    return derived.table(s, d, "supplier").select(
        key.alias("id"), (F.lit(47.4) + (key * 311 % 7200) / 1000.0).alias("lat"), (F.lit(6.4) + (key * 173 % 8200) / 1000.0).alias("lon"))


Q["place_name"] = lambda s, d: rounded(G.place_name(_points(s, d), pl(s, d)))
SQL["place_name"] = sql(f"""SELECT punkt, coalesce(g.ort, o.ort) AS ort, {r('coalesce(g.km, o.km)', 'km')},
CASE WHEN g.ort IS NOT NULL THEN g.name WHEN o.km > 2 THEN 'bei ' || o.name ELSE o.name END AS name
FROM (SELECT punkt, arg_min({{'ort': ort, 'km': km, 'name': name}}, (km, ort)) FILTER (gipfel AND km < 0.5) AS g,
arg_min({{'ort': ort, 'km': km, 'name': name}}, (km, ort)) FILTER (NOT gipfel) AS o FROM nah GROUP BY punkt)
WHERE g IS NOT NULL OR o IS NOT NULL""", PLACES, """pt AS (SELECT s_suppkey AS id, 47.4::DOUBLE + (s_suppkey * 311 % 7200) / 1000.0::DOUBLE AS lat,
6.4::DOUBLE + (s_suppkey * 173 % 8200) / 1000.0::DOUBLE AS lon FROM supplier)""",
    f"""nah AS (SELECT pt.id AS punkt, pl.id AS ort, pl.name, pl.gipfel, {hav('pt.lat', 'pt.lon', 'pl.lat', 'pl.lon')} AS km FROM pt, pl
WHERE abs(floor(pl.lat * 1000 + 0.5) - floor(pt.lat * 1000 + 0.5)) <= 150 AND abs(floor(pl.lon * 1000 + 0.5) - floor(pt.lon * 1000 + 0.5)) <= 250)""")

# ---- radar grid --------------------------------------------------------------------------
_A, _B = "6378137.0::DOUBLE", "6356752.3142451802::DOUBLE"
_EXC = f"sqrt(1 - ({_B} * {_B}) / ({_A} * {_A}))"


def _t(phi: str) -> str:
    return f"(tan(pi() / 4 - ({phi}) / 2) / pow((1 - {_EXC} * sin({phi})) / (1 + {_EXC} * sin({phi})), {_EXC} / 2))"


_PC = "radians(60)"
_RHO = f"({_A} * (cos({_PC}) / sqrt(1 - pow({_EXC}, 2) * pow(sin({_PC}), 2))) * {_t('radians(lat)')} / {_t(_PC)})"
_GX = f"((543196.83521776402::DOUBLE + {_RHO} * sin(radians(lon - 10))) / 1000)"
_GY = f"(-(3622588.8619310018::DOUBLE - {_RHO} * cos(radians(lon - 10))) / 1000)"
Q["grid_positions"] = lambda s, d: rounded(with_grid(pl(s, d)).select("id", "gx", "gy"))
SQL["grid_positions"] = sql(f"SELECT id, {r(_GX, 'gx')}, {r(_GY, 'gy')} FROM pl", PLACES)
Q["grid_and_back"] = lambda s, d: rounded(with_lonlat(with_grid(pl(s, d)).select("id", "gx", "gy")).select("id", "lon", "lat"))
SQL["grid_and_back"] = sql(f"SELECT id, {rs('lon', 'lat')} FROM pl", PLACES)
Q["station_points"] = lambda s, d: rounded(G.station_points(st(s, d), YEAR))
SQL["station_points"] = sql(f"SELECT id, name, {r(_GX, 'gx')}, {r(_GY, 'gy')} FROM sst WHERE lat IS NOT NULL AND year(bis) >= {YEAR - 1}", SUPPLIERS)
Q["windows_around"] = lambda s, d: B.windows_around(with_grid(pl(s, d)), 250)
SQL["windows_around"] = sql(f"""SELECT id, y - 125 AS oben, x - 125 AS links, y + 125 AS unten, x + 125 AS rechts FROM (SELECT id,
least({GRID_COLUMNS - 126}, greatest(125, floor({_GX} + 0.5)))::INTEGER AS x, least({GRID_ROWS - 126}, greatest(125, floor({_GY} + 0.5)))::INTEGER AS y FROM pl)""", PLACES)

# ---- frames and pixels: one frame of 6 x 5 pixels per hour of the events --------------------
BBOX = (100, 200, 105, 204)
_PACK = "timestamp timestamp, precipitation_5 string"


def _frames(s, d):
    """Packed frames from the events: pixel value from the event's value and position."""
    import base64

    rows = derived.table(s, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp")).agg(
        F.sum(F.floor(F.col("value"))).cast("long").alias("v"))

    def pack(batches):
        for b in batches:
            out = []
            for v in b["v"]:
                grid = (int(v) * (np.arange(30) + 1)) % 500
                out.append(base64.b64encode(zlib.compress(grid.astype("<u2").tobytes())).decode())
            yield pd.DataFrame({"timestamp": b["timestamp"], "precipitation_5": out})
    return rows.mapInPandas(pack, _PACK)


_PIX = """px AS (SELECT zeit AS timestamp, 100 + i // 5 AS zeile, 200 + i % 5 AS spalte, (v * (i + 1) % 500)::INTEGER AS raw
FROM (SELECT date_trunc('hour', ts) AS zeit, sum(floor(value))::BIGINT AS v FROM events GROUP BY 1), range(0, 30) t(i))"""
Q["read_frames"] = lambda s, d: read_frames(_frames(s, d), BBOX)
SQL["read_frames"] = sql("SELECT * FROM px", _PIX)
Q["read_frames_window"] = lambda s, d: read_frames(_frames(s, d), BBOX, (101, 200, 103, 202))
SQL["read_frames_window"] = sql("SELECT * FROM px WHERE zeile BETWEEN 101 AND 103 AND spalte <= 202", _PIX)
Q["crop"] = lambda s, d: B.crop(read_frames(_frames(s, d), BBOX), (102, 201, 110, 203))
SQL["crop"] = sql("SELECT * FROM px WHERE zeile >= 102 AND spalte BETWEEN 201 AND 203", _PIX)
_CLASS = "CASE " + " ".join(f"WHEN mm_h >= {v} THEN {i}" for i, v in reversed(list(enumerate(RAIN_CLASSES)))) + " END"
Q["rain_pixels"] = lambda s, d: rounded(B.rain_pixels(read_frames(_frames(s, d), BBOX)))
SQL["rain_pixels"] = sql(f"SELECT timestamp, zeile, spalte, raw, {r('mm_h', 'mm_h')}, {_CLASS} AS klasse FROM (SELECT *, raw * 12 / 100.0::DOUBLE AS mm_h FROM px)", _PIX)


def _parts_block(s, d):
    f = _frames(s, d)
    return f.where(F.hour("timestamp") % 2 == 0).withColumn("precipitation_5", F.lit("einzeln")), f.where(F.hour("timestamp") % 3 == 0)


Q["merge_frames"] = lambda s, d: B.merge_frames(*_parts_block(s, d)).select("timestamp", (F.col("precipitation_5") == "einzeln").alias("einzeln"))
SQL["merge_frames"] = """SELECT DISTINCT date_trunc('hour', ts) AS timestamp, hour(ts) % 2 = 0 AS einzeln FROM events WHERE hour(ts) % 2 = 0 OR hour(ts) % 3 = 0"""


def _fives(s, d):
    return derived.table(s, d, "events").select(F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 300) * 300).alias("timestamp")).distinct()


_FIVE = "fr AS (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, ts) AS timestamp FROM events)"
for _h, _step in ((1, 5), (3, 10), (6, 15)):
    Q[f"sample_frames_{_h}h"] = lambda s, d, h=_h: B.sample_frames(_fives(s, d), F.lit("2024-01-12 03:47:00").cast("timestamp"), h)
    SQL[f"sample_frames_{_h}h"] = sql(f"""SELECT timestamp FROM fr WHERE (timestamp BETWEEN TIMESTAMP '2024-01-12 03:45:00' AND TIMESTAMP '2024-01-12 05:45:00')
OR (timestamp < TIMESTAMP '2024-01-12 03:45:00' AND timestamp >= time_bucket(INTERVAL {_step} MINUTE, TIMESTAMP '2024-01-12 03:45:00' - INTERVAL {_h} HOUR) AND minute(timestamp) % {_step} = 0)""", _FIVE)


def _pixels_of_orders(s, d):
    return derived.table(s, d, "orders").select(
        F.col("o_orderkey").alias("nr"), (F.col("o_orderkey") * 7919 % GRID_ROWS).cast("int").alias("zeile"),
        (F.col("o_orderkey") * 104729 % GRID_COLUMNS).cast("int").alias("spalte"))


Q["crop_around"] = lambda s, d: B.crop_around(_pixels_of_orders(s, d), with_grid(st(s, d).where("lat IS NOT NULL")), 60)
SQL["crop_around"] = sql(f"""SELECT nr, zeile, spalte, id FROM (SELECT o_orderkey AS nr, o_orderkey * 7919 % {GRID_ROWS} AS zeile, o_orderkey * 104729 % {GRID_COLUMNS} AS spalte FROM orders),
(SELECT id, least({GRID_COLUMNS - 31}, greatest(30, floor({_GX} + 0.5))) AS x, least({GRID_ROWS - 31}, greatest(30, floor({_GY} + 0.5))) AS y FROM sst WHERE lat IS NOT NULL)
WHERE zeile BETWEEN y - 30 AND y + 30 AND spalte BETWEEN x - 30 AND x + 30""", SUPPLIERS)

# ---- search -----------------------------------------------------------------------------------
# queries: the last digits of each nation's number behind a part of the name
_TEXT = "CASE n_nationkey % 4 WHEN 0 THEN 'customer#' WHEN 1 THEN 'CUST' WHEN 2 THEN '' ELSE 'omer 0' END || CASE n_nationkey % 4 WHEN 0 THEN lpad(n_nationkey::VARCHAR, 9, '0') WHEN 1 THEN ', ' || n_nationkey ELSE n_nationkey::VARCHAR END"


def _asked(s, d):
    k = F.col("n_nationkey")
    head = F.when(k % 4 == 0, "customer#").when(k % 4 == 1, "CUST").when(k % 4 == 2, "").otherwise("omer 0")
    tail = F.when(k % 4 == 0, F.lpad(k.cast("string"), 9, "0")).when(k % 4 == 1, F.concat(F.lit(", "), k)).otherwise(k.cast("string"))
    return derived.table(s, d, "nation").select(k.alias("anfrage"), F.concat(head, tail).alias("text"))


_WORDS = f"fr AS (SELECT n_nationkey AS anfrage, lower(trim({_TEXT})) AS q, list_filter(regexp_split_to_array(lower(trim({_TEXT})), '[\\s,]+'), lambda x: x <> '') AS w FROM nation)"


def _all(cond: str) -> str:
    return f"len(list_filter(w, lambda x: {cond})) = len(w)"


Q["search_places"] = lambda s, d: X.search_places(_asked(s, d), pl(s, d), 20)
SQL["search_places"] = sql(f"""SELECT anfrage, nr, rang, id, name FROM (SELECT *, row_number() OVER (PARTITION BY anfrage ORDER BY rang, einwohner DESC,
CASE WHEN gipfel THEN -hoehe ELSE 0 END, name, id) AS nr FROM (SELECT anfrage, id, name, einwohner, hoehe, gipfel, CASE WHEN n = q THEN 0 WHEN starts_with(n, q) THEN 1
WHEN {_all("starts_with(n, x) OR contains(n, ' ' || x) OR contains(n, '-' || x)")} THEN 2 ELSE 3 END AS rang
FROM fr, (SELECT *, lower(name) AS n FROM pl) WHERE q <> '' AND {_all('contains(n, x)')})) WHERE nr <= 20""", PLACES, _WORDS)


def _station_texts(s, d):
    k = F.col("n_nationkey")
    return derived.table(s, d, "nation").select(k.alias("anfrage"), F.when(k % 3 == 0, k.cast("string")).when(
        k % 3 == 1, F.concat(F.lit("supp land "), k)).otherwise(F.concat(F.lit("supplier#00000000"), k % 10)).alias("text"))


_STEXT = "CASE n_nationkey % 3 WHEN 0 THEN n_nationkey::VARCHAR WHEN 1 THEN 'supp land ' || n_nationkey ELSE 'supplier#00000000' || n_nationkey % 10 END"
Q["search_stations"] = lambda s, d: X.search_stations(_station_texts(s, d), st(s, d), 15)
SQL["search_stations"] = sql(f"""SELECT anfrage, nr, rang, id, name FROM (SELECT *, row_number() OVER (PARTITION BY anfrage ORDER BY rang, name, id) AS nr FROM (
SELECT anfrage, id, name, CASE WHEN regexp_full_match(q, '\\d+') AND try_cast(q AS BIGINT) = id THEN 0 WHEN starts_with(n, q) THEN 1
WHEN {_all("starts_with(n, x) OR contains(n, ' ' || x) OR contains(n, '-' || x) OR contains(n, '(' || x)")} THEN 2 WHEN {_all('contains(n, x)')} THEN 3 ELSE 4 END AS rang
FROM fr, (SELECT *, lower(name) AS n, lower(land) AS l, lpad(id::VARCHAR, 5, '0') AS z FROM sst) WHERE {_all('contains(n, x) OR contains(l, x) OR contains(z, x)')})) WHERE nr <= 15""",
    SUPPLIERS, _WORDS.replace(_TEXT, _STEXT))


def _choice(s, d):
    overview = station_overview(derived.stations(s, d), derived.observations(s, d).where("station > 12"))
    favs = derived.stations(s, d).where("hoehe = 1600").select(F.col("id").alias("station"), (-F.col("id")).alias("nr"))
    return rounded(X.station_choice(overview, favs))


Q["station_choice"] = _choice
SQL["station_choice"] = sql("""SELECT id, name, land, hoehe, year(von) AS von, bis, coalesce(n, 0) AS tage, lat, lon,
CASE WHEN hoehe = 1600 THEN 0 WHEN n > 0 THEN 1 ELSE 2 END AS gruppe FROM st LEFT JOIN (SELECT station, count(*) AS n FROM obs WHERE station > 12 GROUP BY station) o ON o.station = id""", OBS, STATIONS)

# ---- gazetteer and cities: rows made of customers ------------------------------------------------


def _gazetteer_rows(s, d):
    k = F.col("c_custkey")
    cells = {i: F.lit("") for i in range(Z.COLUMNS)} | {
        0: k.cast("string"), 1: F.col("c_name"), 4: ((k * 37 % 700) / 100 + 47.5).cast("string"), 5: ((k * 53 % 800) / 100 + 6.5).cast("string"),
        6: F.when(k % 5 == 0, "T").when(k % 7 == 0, "H").otherwise("P"), 7: F.when(k % 10 == 0, "PK").when(k % 15 == 0, "MT").when(k % 11 == 0, "PPLH").otherwise("PPL"),
        10: F.lpad((F.col("c_nationkey") % 20).cast("string"), 2, "0"), 14: F.when(k % 3 == 0, F.floor(F.abs("c_acctbal")).cast("string")).otherwise(""),
        15: F.when(k % 4 == 0, (k % 900).cast("string")).otherwise(""), 16: F.when(k % 6 == 0, "-9999").otherwise((k % 1700).cast("string"))}
    return derived.table(s, d, "customer").select(*[c.alias(f"_c{i}") for i, c in cells.items()])


Q["read_places"] = lambda s, d: Z.parse_places(_gazetteer_rows(s, d))
SQL["read_places"] = f"""SELECT k::VARCHAR AS id, c_name AS name, round_even(((k * 37 % 700) / 100.0::DOUBLE + 47.5::DOUBLE) * 1000, 0)::INTEGER AS lat_m,
round_even(((k * 53 % 800) / 100.0::DOUBLE + 6.5::DOUBLE) * 1000, 0)::INTEGER AS lon_m,
round_even(((k * 37 % 700) / 100.0::DOUBLE + 47.5::DOUBLE) * 1000, 0) / 1000 AS lat, round_even(((k * 53 % 800) / 100.0::DOUBLE + 6.5::DOUBLE) * 1000, 0) / 1000 AS lon, CASE WHEN k % 4 = 0 THEN k % 900 WHEN k % 6 <> 0 THEN k % 1700 END AS hoehe,
CASE c_nationkey % 20 {' '.join(f"WHEN {int(c)} THEN '{n}'" for c, n in Z.STATES.items())} END AS land,
CASE WHEN k % 3 = 0 THEN floor(abs(c_acctbal))::BIGINT ELSE 0 END AS einwohner, k % 5 = 0 AS gipfel FROM (SELECT *, c_custkey AS k FROM customer)
WHERE c_nationkey % 20 BETWEEN 1 AND 16 AND ((k % 5 = 0 AND (k % 10 = 0 OR k % 15 = 0)) OR (k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0))"""


def _features(s, d):
    k = F.col("c_custkey")
    body = F.to_json(F.struct(F.struct(
        F.col("c_name").alias("NAME"), F.when(k % 2 == 0, F.concat(F.lit("Stadt "), k)).alias("NAME_DE"),
        F.when(k % 3 == 0, "DEU").otherwise("XXX").alias("ADM0_A3"), (F.floor(F.abs("c_acctbal")) * 150).alias("POP_MAX"),
        F.when(k % 50 == 0, 1).otherwise(0).alias("ADM0CAP"), (F.lit(1.0) + k * 53 % 200 / 10).alias("LONGITUDE"),
        (F.lit(44.0) + k * 37 % 140 / 10).alias("LATITUDE")).alias("properties")))
    return derived.table(s, d, "customer").select(F.from_json(body, Z.FEATURE).alias("feature"))


Q["city_layer"] = lambda s, d: rounded(Z.city_layer(_features(s, d)))
SQL["city_layer"] = f"""SELECT name, {rs('gx', 'gy')}, rang FROM (SELECT *, {_GX} AS gx, {_GY} AS gy FROM (
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Stadt ' || c_custkey ELSE c_name END AS name, floor(abs(c_acctbal)) * 150 AS pop, c_custkey % 50 = 0 AS cap, c_custkey % 3 = 0 AS de,
1.0::DOUBLE + c_custkey * 53 % 200 / 10.0::DOUBLE AS lon, 44.0::DOUBLE + c_custkey * 37 % 140 / 10.0::DOUBLE AS lat,
CASE WHEN floor(abs(c_acctbal)) * 150 >= 1000000 OR c_custkey % 50 = 0 THEN 1 WHEN floor(abs(c_acctbal)) * 150 >= 300000 THEN 2 ELSE 3 END AS rang FROM customer)
WHERE (de AND pop >= 100000) OR cap OR pop >= 500000) WHERE gx BETWEEN 0 AND {GRID_COLUMNS} AND gy BETWEEN 0 AND {GRID_ROWS}"""
