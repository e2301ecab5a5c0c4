"""Product files, archives, listings, merge, refresh, retention, store, streaming ingest."""

from __future__ import annotations


from pyspark.sql import functions as F

from isotherm.operators import ingest as I
from isotherm.operators.national import national_snapshot
from isotherm.plans import rollup, store
from isotherm.plans.views import failed_stations
from isotherm.schema import MEASURES, PRODUCT_FIELDS
from isotherm.session import new_folder
from isotherm.sources import daily as S, derived, listings as L
from isotherm.streaming.recent import failed_arrivals, stream_recent
from verification.analyses import _SNAP
from verification.base import OBS, clean_cte, cleaned, obs, over_c, over_obs, r, rounded, rs

Q: dict = {}
SQL: dict = {}
_ALL = "station, datum, qn, qn3, quelle, rskf, " + rs(*MEASURES)


# ---- product lines written from the observations ------------------------------------------
# the path carries station and year; odd years lack two columns; stations of the second kind break
def _lines(s, d):
    o = obs(s, d).withColumn("j", F.year("datum"))
    path = F.concat(F.lit("mem:/"), "station", F.lit("/"), "j", F.lit(".txt"))

    def text(field, col):
        value = F.coalesce(F.col(col).cast("string"), F.lit("-999"))
        # a value that is missing, one padded, one unreadable
        value = F.when(F.lit(field == "RSK") & (F.day("datum") == 13), F.lit(" -999")).otherwise(value)
        value = F.when(F.lit(field == "TMK") & (F.col("station") == 32) & (F.col("j") == 1996) & (F.day("datum") == 1), F.lit("x")).otherwise(value)
        return F.lpad(value, 24, " ")

    sid = F.when((F.col("station") == 12) & (F.col("j") == 1995) & (F.day("datum") == 1), F.lit("?")).otherwise(F.col("station").cast("string"))

    def row(skip):
        fields = [(f, c) for f, c in PRODUCT_FIELDS.items() if f not in skip]
        return (";".join(["STATIONS_ID", "MESS_DATUM"] + [f"  {f}" for f, _ in fields] + ["eor"]) + "\r",
                F.concat_ws(";", sid, F.date_format("datum", "yyyyMMdd"), *[text(f, c) for f, c in fields], F.lit("eor\r")))

    (head, body), (head_odd, body_odd) = row(()), row(("NM", "QN_3"))
    odd = F.col("j") % 2 == 1
    rows = o.select(path.alias("path"), F.unix_date("datum").cast("bigint").alias("ord"), F.when(odd, body_odd).otherwise(body).alias("value"))
    heads = o.select("station", "j").distinct().select(path.alias("path"), F.lit(-10**6).cast("bigint").alias("ord"), F.when(
        (F.col("station") == 31) & (F.col("j") == 1997), F.lit("A;B;C\r")).when(
        (F.col("station") == 11) & (F.col("j") == 1994), F.replace(F.lit(head), F.lit("STATIONS_ID;"), F.lit("X;"))).when(odd, head_odd).otherwise(head).alias("value"))
    blank = o.select("station", "j").distinct().select(path.alias("path"), F.lit(10**6).cast("bigint").alias("ord"), F.lit("1;        ;;;;;;;\r").alias("value"))
    return rows.unionByName(heads).unionByName(blank)


_KEPT = "NOT (station = 31 AND year(datum) = 1997) AND NOT (station = 32 AND year(datum) = 1996 AND EXISTS (SELECT 1 FROM obs x WHERE x.station = 32 AND year(x.datum) = 1996 AND day(x.datum) = 1)) AND NOT (station = 11 AND year(datum) = 1994) AND NOT (station = 12 AND year(datum) = 1995 AND EXISTS (SELECT 1 FROM obs x WHERE x.station = 12 AND year(x.datum) = 1995 AND day(x.datum) = 1))"
_READ = f"""SELECT station, datum, qn, CASE WHEN year(datum) % 2 = 0 THEN qn3 END AS qn3, 0 AS quelle, rskf,
{', '.join(r({'rsk': 'CASE WHEN day(datum) <> 13 THEN rsk END', 'nm': 'CASE WHEN year(datum) % 2 = 0 THEN nm END'}.get(m, m), m) for m in MEASURES)}
FROM obs WHERE {_KEPT}"""


def _texts(s, d):
    # a year of one station: at most 368 lines
    return _lines(s, d).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "value"))).alias("l")).select(
        "path", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("text"))


def _files(s, d):
    return S.parse_files(_texts(s, d).select("path", F.encode("text", "ISO-8859-1").alias("content")))


Q["read_daily"] = lambda s, d: rounded(S.observations_of(_files(s, d)).drop("path"))
SQL["read_daily"] = over_obs(_READ)
Q["failed_files"] = lambda s, d: S.failed_files(_files(s, d)).select("path", F.substring("fehler", 1, 10).alias("fehler"))
SQL["failed_files"] = over_obs("""SELECT DISTINCT 'mem:/' || station || '/' || year(datum) || '.txt' AS path, CASE WHEN station IN (11, 31) THEN 'unexpected' ELSE 'unreadable' END AS fehler
FROM obs WHERE (station = 31 AND year(datum) = 1997) OR (station = 32 AND year(datum) = 1996 AND day(datum) = 1)
 OR (station = 11 AND year(datum) = 1994) OR (station = 12 AND year(datum) = 1995 AND day(datum) = 1)""")


def _archives(s, d):
    """One zip per station and year; one is cut short, one lacks the product file."""
    import io
    import zipfile

    import pandas as pd

    def pack(batches):
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr("Metadaten.txt", "x")
                    if "11/1998" not in path:
                        z.writestr("produkt_klima_tag_x.txt", text.encode("latin-1"))
                data = buffer.getvalue()
                out.append(data[:20] if "12/1999" in path else data)
            yield pd.DataFrame({"path": [p.replace(".txt", "_akt.zip") for p in b["path"]], "content": out})
    return _texts(s, d).mapInPandas(pack, "path string, content binary")


Q["read_archives"] = lambda s, d: rounded(S.observations_of(S.parse_archives(_archives(s, d))).drop("path"))
SQL["read_archives"] = over_obs(_READ.replace(_KEPT, f"{_KEPT} AND NOT (station = 11 AND year(datum) = 1998) AND NOT (station = 12 AND year(datum) = 1999)").replace("0 AS quelle", "1 AS quelle"))
Q["failed_archives"] = lambda s, d: S.failed_files(S.parse_archives(_archives(s, d))).select("path", F.substring("fehler", 1, 7).alias("fehler"))
_FAILED = """SELECT DISTINCT 'mem:/' || station || '/' || year(datum) || '_akt.zip' AS path, CASE WHEN station = 11 AND year(datum) = 1998 THEN 'no file' WHEN station = 12 AND year(datum) = 1999 THEN 'archive'
 WHEN station IN (11, 31) THEN 'unexpec' ELSE 'unreada' END AS fehler
FROM obs WHERE (station = 11 AND year(datum) IN (1994, 1998)) OR (station = 12 AND (year(datum) = 1999 OR year(datum) = 1995 AND day(datum) = 1))
 OR (station = 31 AND year(datum) = 1997) OR (station = 32 AND year(datum) = 1996 AND day(datum) = 1)"""
SQL["failed_archives"] = over_obs(_FAILED)


Q["failed_stations"] = lambda s, d: failed_stations(S.failed_files(S.parse_archives(_archives(s, d))), r"mem:/([0-9]+)/").select("station", F.substring("fehler", 1, 7).alias("fehler"))
SQL["failed_stations"] = f"SELECT split_part(path, '/', 2)::INTEGER AS station, fehler FROM ({SQL['failed_archives']})"


# good and failed archives from one pass
Q["load_report"] = lambda s, d: S.load_report(S.parse_archives(_archives(s, d))).withColumn("fehler", F.substring("fehler", 1, 7))
SQL["load_report"] = over_obs(f"""SELECT path, tage, von, bis, fehler FROM (SELECT 'mem:/' || station || '/' || year(datum) || '_akt.zip' AS path, count(*) AS n, min(datum) AS v, max(datum) AS b FROM obs GROUP BY station, year(datum)) a
LEFT JOIN ({_FAILED}) f USING (path), LATERAL (SELECT CASE WHEN fehler IS NULL THEN n ELSE 0 END AS tage, CASE WHEN fehler IS NULL THEN v END AS von, CASE WHEN fehler IS NULL THEN b END AS bis)""")


def _station_lines(s, d):
    k = F.col("s_suppkey")
    line = F.concat_ws(" ", F.lpad(k.cast("string"), 5, "0"), F.lit("19370101"), F.when(k % 9 == 0, "offen").otherwise("20060630"), F.lpad((k % 3000).cast("string"), 12, " "),
                       F.format_string("%.4f", F.lit(47) + k % 700 / 100), F.format_string("%9.4f", F.lit(6) + k % 800 / 100),
                       F.rpad(F.concat(F.lit("Bad "), F.col("s_name")), 40, " "), F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("Land"), F.col("s_nationkey"))), F.lit("   Frei"))
    rows = derived.table(s, d, "supplier").select(line.alias("value"))
    heads = derived.table(s, d, "region").select(F.concat(F.lit("----- Stations_id von_datum "), "r_name").alias("value"))
    return rows.unionByName(heads)


Q["read_stations"] = lambda s, d: rounded(L.parse_stations(_station_lines(s, d)))
SQL["read_stations"] = f"""SELECT s_suppkey AS id, 'Bad ' || s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'Frei' ELSE 'Land' || s_nationkey END AS land, s_suppkey % 3000 AS hoehe,
{r('47 + s_suppkey % 700 / 100.0::DOUBLE', 'lat')}, {r('6 + s_suppkey % 800 / 100.0::DOUBLE', 'lon')}, DATE '1937-01-01' AS von, DATE '2006-06-30' AS bis FROM supplier WHERE s_suppkey % 9 <> 0"""

# ---- listings: links of the pages ------------------------------------------------------------
_LINK = r'href="(/([A-Za-z])[^"]*)"'


def _pages(s, d):
    return derived.table(s, d, "pages").select(F.col("page_id").alias("seite"), "html")


Q["archive_manifest"] = lambda s, d: L.archive_manifest(_pages(s, d), _LINK, numeric=False)
SQL["archive_manifest"] = f"""SELECT k AS station, arg_max(f, (page_id, i)) AS datei FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS f,
unnest(regexp_extract_all(html, '{_LINK}', 2)) AS k, unnest(range(len(regexp_extract_all(html, '{_LINK}', 1)))) AS i FROM pages) GROUP BY k"""
Q["active_stations"] = lambda s, d: L.active_stations(_pages(s, d), r'href="/([^"]+)"', numeric=False)
SQL["active_stations"] = """SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS station FROM pages"""

# the same with the patterns of the library, on listings written from suppliers
def _listings(s, d):
    k = F.col("s_suppkey")
    return derived.table(s, d, "supplier").select((k % 7).alias("seite"), F.concat(
        F.format_string('<a href="tageswerte_KL_%05d_19370101_2000%02d31_hist.zip">x</a> ', k % 40, k % 12 + 1),
        F.when(k % 3 == 0, F.format_string('<a href="tageswerte_KL_%05d_akt.zip">y</a>', k)).otherwise(F.lit("<p>"))).alias("html"), k)


Q["archive_manifest_links"] = lambda s, d: L.archive_manifest(_listings(s, d).select(F.col("s_suppkey").alias("seite"), "html"))
SQL["archive_manifest_links"] = """SELECT s_suppkey % 40 AS station, arg_max(printf('tageswerte_KL_%05d_19370101_2000%02d31_hist.zip', s_suppkey % 40, s_suppkey % 12 + 1), s_suppkey) AS datei
FROM supplier GROUP BY s_suppkey % 40"""
Q["active_station_links"] = lambda s, d: L.active_stations(_listings(s, d))
SQL["active_station_links"] = "SELECT s_suppkey AS station FROM supplier WHERE s_suppkey % 3 = 0"

# ---- merge and refresh ---------------------------------------------------------------------------
_CUT = "DATE '2000-06-30'"


def _hist(s, d):
    return obs(s, d).where("quelle = 0")


def _recent(s, d):
    """Overlaps the historical part by half a year, with other values there."""
    overlap = F.col("datum") <= F.lit("2000-12-31").cast("date")
    return obs(s, d).where(F.col("datum") > F.lit("2000-06-30").cast("date")).withColumn(
        "tmk", F.when(overlap, F.col("tmk") + 1).otherwise(F.col("tmk"))).withColumn("quelle", F.lit(1))


def _second(s, d):
    """The next recent delivery of half of the stations."""
    return _recent(s, d).where("station % 10 = 1").withColumn("tmk", F.col("tmk") + 0.5)


_RECENT = f"rec AS (SELECT * REPLACE (CASE WHEN datum <= DATE '2000-12-31' THEN tmk + 1 ELSE tmk END AS tmk, 1 AS quelle) FROM obs WHERE datum > {_CUT})"
_MERGED = """ende AS (SELECT station, max(datum) AS e FROM obs WHERE quelle = 0 GROUP BY station),
zusammen AS (SELECT * FROM obs WHERE quelle = 0 UNION ALL SELECT rec.* FROM rec LEFT JOIN ende USING (station) WHERE e IS NULL OR datum > e)"""
_SECOND = """zweite AS (SELECT * REPLACE (tmk + 0.5::DOUBLE AS tmk) FROM rec WHERE station % 10 = 1),
neu AS (SELECT * FROM zusammen WHERE quelle = 0 OR station % 10 <> 1 UNION ALL SELECT zweite.* FROM zweite LEFT JOIN ende USING (station) WHERE e IS NULL OR datum > e)"""
Q["merge_sources"] = lambda s, d: rounded(I.merge_sources(_hist(s, d), _recent(s, d)))
SQL["merge_sources"] = over_obs(f"SELECT {_ALL} FROM zusammen", _RECENT, _MERGED)
Q["replace_recent"] = lambda s, d: rounded(I.replace_recent(I.merge_sources(_hist(s, d), _recent(s, d)), _second(s, d)))
SQL["replace_recent"] = over_obs(f"SELECT {_ALL} FROM neu", _RECENT, _MERGED, _SECOND)


def _manifest(s, d):
    return derived.table(s, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").cast("int").alias("station"), F.concat(F.lit("hist_"), F.col("s_nationkey"), F.lit(".zip")).alias("datei"))


def _state(s, d):
    return derived.table(s, d, "supplier").where("s_suppkey % 3 <> 0").select(
        F.col("s_suppkey").cast("int").alias("station"), F.when(F.col("s_suppkey") % 7 == 0, F.lit("alt.zip")).otherwise(F.concat(F.lit("hist_"), F.col("s_nationkey"), F.lit(".zip"))).alias("hist_datei"),
        F.when(F.col("s_suppkey") % 11 != 0, F.col("s_suppkey") * 600.0).alias("recent_am"))


_MAN = "man AS (SELECT s_suppkey AS station, 'hist_' || s_nationkey || '.zip' AS datei FROM supplier WHERE s_suppkey % 5 <> 0)"
_STATE = """zst AS (SELECT s_suppkey AS station, CASE WHEN s_suppkey % 7 = 0 THEN 'alt.zip' ELSE 'hist_' || s_nationkey || '.zip' END AS hist_datei,
CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey * 600.0::DOUBLE END AS recent_am FROM supplier WHERE s_suppkey % 3 <> 0)"""
Q["refresh_plan"] = lambda s, d: I.refresh_plan(_manifest(s, d), _state(s, d), 50000.0)
SQL["refresh_plan"] = f"""WITH {_MAN}, {_STATE} SELECT coalesce(man.station, zst.station) AS station, datei, hist_datei, recent_am,
CASE WHEN zst.station IS NULL OR datei <> hist_datei THEN 'voll' WHEN recent_am IS NULL OR 50000 - recent_am > 10800 THEN 'recent' ELSE 'nichts' END AS aktion
FROM man FULL JOIN zst ON man.station = zst.station"""


def _loads(s, d):
    return derived.table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("int").alias("station"), F.when(F.col("s_suppkey") % 4 == 0, "neu.zip").alias("hist_datei"), F.when(F.col("s_suppkey") % 6 == 0, 99999.0).alias("recent_am"))


Q["update_load_state"] = lambda s, d: I.update_load_state(_state(s, d), _loads(s, d))
SQL["update_load_state"] = f"""WITH {_STATE} SELECT coalesce(zst.station, l.station) AS station, coalesce(l.d, hist_datei) AS hist_datei, coalesce(l.r, recent_am) AS recent_am
FROM zst FULL JOIN (SELECT s_suppkey AS station, CASE WHEN s_suppkey % 4 = 0 THEN 'neu.zip' END AS d, CASE WHEN s_suppkey % 6 = 0 THEN 99999.0::DOUBLE END AS r FROM supplier WHERE s_suppkey % 2 = 0) l ON l.station = zst.station"""


def _obsolete(s, d):
    files = derived.table(s, d, "supplier").select(F.concat(F.lit("hist_"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 8 == 0, ".neu").otherwise(".zip")).alias("datei"))
    return I.obsolete_archives(files, _manifest(s, d), _state(s, d).select("station"))


Q["obsolete_archives"] = _obsolete
SQL["obsolete_archives"] = f"""WITH {_MAN}, {_STATE} SELECT datei FROM (SELECT 'hist_' || s_suppkey || CASE WHEN s_suppkey % 8 = 0 THEN '.neu' ELSE '.zip' END AS datei FROM supplier)
WHERE datei LIKE '%.zip' AND datei NOT IN (SELECT datei FROM man WHERE station IN (SELECT station FROM zst))"""
Q["freshest"] = lambda s, d: rounded(I.freshest(derived.table(s, d, "orders").select(
    F.col("o_custkey").alias("quelle"), F.to_date("o_orderdate").alias("stand"), F.col("o_orderkey").alias("erstellt"), "o_totalprice"), "quelle"))
SQL["freshest"] = f"""SELECT o_custkey AS quelle, o_orderdate::DATE AS stand, o_orderkey AS erstellt, {r('o_totalprice', 'o_totalprice')} FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey DESC) = 1"""


def _runs(s, d):
    return derived.table(s, d, "orders").select(F.col("o_custkey").alias("gruppe"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("erstellt"), F.col("o_orderstatus").alias("status"))


Q["expired"] = lambda s, d: I.expired(_runs(s, d), F.lit("1998-01-01").cast("timestamp"), 2, 14, finished="F")
SQL["expired"] = """SELECT gruppe, id, erstellt, status FROM (SELECT o_custkey AS gruppe, o_orderkey AS id, o_orderdate AS erstellt, o_orderstatus AS status,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nr FROM orders WHERE o_orderstatus = 'F')
WHERE nr > 2 AND erstellt < TIMESTAMP '1998-01-01' - INTERVAL 14 DAY"""

# ---- sinks, store, stream ------------------------------------------------------------------------------


def _folder(s, name):
    return new_folder(s, name)


def _snapshot_written(s, d):
    path, snapshot = _folder(s, "snapshot"), national_snapshot(cleaned(s, d), derived.stations(s, d))
    I.write_snapshot(snapshot.where("station = 11"), path, F.lit("2001-11-04").cast("date"))
    I.write_snapshot(snapshot, path, F.lit("2001-11-05").cast("date"))
    path = I.newest_snapshot(s, path)
    back = s.read.schema("stand date, station int, name string, spalte string, werte array<double>, tage array<date>").json(path)
    return back.select("station", "name", "spalte", "stand", F.posexplode("werte").alias("tag", "wert"))


Q["write_snapshot"] = _snapshot_written
SQL["write_snapshot"] = over_c("""SELECT station, name, spalte, stand.stand, 6 - (stand.stand - datum) AS tag, wert FROM snap, stand""", *_SNAP)


def _stored(s, d):
    path = _folder(s, "store")
    store.write_store(_hist(s, d).unionByName(_recent(s, d)), path, 8)
    return path


def _store_refreshed(s, d):
    path = _stored(s, d)
    store.refresh_recent(s, _second(s, d), path, 8)
    return rounded(store.read_store(s, path))


Q["store_read"] = lambda s, d: rounded(store.read_store(s, _stored(s, d)))
SQL["store_read"] = SQL["merge_sources"]
Q["store_refresh"] = _store_refreshed
SQL["store_refresh"] = SQL["replace_recent"]


def _built(s, d):
    """List, listing and archives as files, put together as one store; years from 1999 on are recent."""
    base = _folder(s, "bau")

    def save(batches):
        import pandas as pd
        from pyarrow import fs

        # "file:/x", as the session writes a local folder, is no address for Arrow
        target, root = fs.FileSystem.from_uri(base.removeprefix("file:") if base.startswith("file:/") else base)
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                station, year = path.removeprefix("mem:/").removesuffix("_akt.zip").split("/")
                kind = "akt" if int(year) >= 1999 else "hist"
                target.create_dir(f"{root}/{kind}", recursive=True)
                with target.open_output_stream(f"{root}/{kind}/tageswerte_{station}_{year}_{kind}.zip") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(b)]})

    _archives(s, d).mapInPandas(save, "n bigint").count()
    _station_lines(s, d).write.text(f"{base}/liste")
    listing = derived.table(s, d, "supplier").select(F.col("s_suppkey").alias("seite"), F.format_string(
        '<a href="tageswerte_KL_%05d_19370101_20001231_hist.zip">', F.col("s_suppkey")).alias("html"))
    made = store.build_dataset(s, f"{base}/liste", listing, f"{base}/hist", f"{base}/akt", f"{base}/out")
    stations, manifest = made["stations"].count(), made["manifest"].count()
    return rounded(store.read_store(s, f"{base}/out/observations")).withColumns({"stationen": F.lit(stations), "dateien": F.lit(manifest)})


Q["build_dataset"] = _built
SQL["build_dataset"] = SQL["read_archives"].replace("1 AS quelle", "CASE WHEN year(datum) >= 1999 THEN 1 ELSE 0 END AS quelle, (SELECT count(*) FROM supplier WHERE s_suppkey % 9 <> 0) AS stationen, (SELECT count(*) FROM supplier) AS dateien")
def _streamed(s, d, broken=False):
    """Recent product files arrive in a folder; the stream brings them into the store.

    With ``broken`` the file of every station of the second kind has no usable head.
    """
    path, base = _stored(s, d), _folder(s, "eingang")
    new = _recent(s, d).withColumn("tmk", F.col("tmk") + 0.5) if broken else _second(s, d)
    fields = list(PRODUCT_FIELDS.items())
    body = F.concat_ws(";", F.col("station").cast("string"), F.date_format("datum", "yyyyMMdd"), *[F.coalesce(F.col(c).cast("string"), F.lit("-999")) for _, c in fields], F.lit("eor"))
    head = ";".join(["STATIONS_ID", "MESS_DATUM", *[f for f, _ in fields], "eor"])
    first = F.when((F.col("station") % 10 == 2) & F.lit(broken), F.lit("kein Kopf")).otherwise(F.lit(head))
    lines = new.select("station", F.unix_date("datum").alias("ord"), body.alias("value")).unionByName(
        new.select("station").distinct().select("station", F.lit(-10**6).alias("ord"), first.alias("value")))
    # one file per station, the header first
    lines.repartition("station").sortWithinPartitions("station", "ord").select("station", "value").write.partitionBy("station").text(f"{base}/in")
    stream_recent(s, f"{base}/in/*", path, f"{base}/state", f"{base}/failed", 8).awaitTermination()
    if broken:
        return failed_arrivals(s, f"{base}/failed").select(
            F.regexp_extract("path", "station=([0-9]+)", 1).cast("int").alias("station"), F.substring("fehler", 1, 17).alias("fehler"))
    return rounded(store.read_store(s, path))


Q["stream_failed"] = lambda s, d: _streamed(s, d, True)
SQL["stream_failed"] = over_obs(f"SELECT DISTINCT station, 'unexpected header' AS fehler FROM rec WHERE station % 10 = 2", _RECENT)
Q["stream_recent"] = _streamed
SQL["stream_recent"] = SQL["replace_recent"]


# ---- versioned store with its monthly summary, after two refreshes -----------------------------------------
def _rolled(s, d):
    path = _folder(s, "rollup")
    rollup.build_rollup_store(s, _hist(s, d).unionByName(_recent(s, d)), path, 4)
    rollup.refresh_rollup_store(s, _second(s, d).where("month(datum) <> 7").withColumn("txk", F.col("txk") + 7), path, 4)
    rollup.refresh_rollup_store(s, _second(s, d), path, 4)
    return path


def _over_new(select):
    return "WITH " + ",\n".join([OBS, _RECENT, _MERGED, _SECOND, clean_cte().replace("FROM obs", "FROM neu")]) + "\n" + select


Q["rollup_days"] = lambda s, d: rounded(rollup.read_days(s, _rolled(s, d)))
SQL["rollup_days"] = SQL["replace_recent"]
Q["store_rollup"] = lambda s, d: rounded(rollup.read_months(s, _rolled(s, d)))
_SUMMED = ", ".join(f"count({m}) AS n_{m}, {r(f'sum({m})', f'sum_{m}')}, {r(f'min({m})', f'min_{m}')}, {r(f'max({m})', f'max_{m}')}" for m in MEASURES)
_DATES = ", ".join(f"min(datum) FILTER ({m} = {x}) AS {name}" for name, (m, x) in rollup.DATED.items())
_LIMITS = ", ".join(f"min({m}) OVER g AS min_{m}, max({m}) OVER g AS max_{m}" for m in ("tmk", "txk", "tnk"))
SQL["store_rollup"] = _over_new(f"""SELECT * FROM (SELECT station, date_trunc('month', datum)::DATE AS monat, count(*) AS tage, {_SUMMED} FROM c GROUP BY ALL)
JOIN (SELECT station, monat, {_DATES} FROM (SELECT station, datum, date_trunc('month', datum)::DATE AS monat, tmk, txk, tnk, {_LIMITS} FROM c
WINDOW g AS (PARTITION BY station, date_trunc('month', datum))) GROUP BY ALL) USING (station, monat)""")
Q["rollup_yearly_mean"] = lambda s, d: rounded(rollup.yearly_means(rollup.read_months(s, _rolled(s, d))))
SQL["rollup_yearly_mean"] = _over_new(f"SELECT station, year(datum) AS jahr, {r('avg(tmk)', 'm')}, count(tmk) AS tage FROM c GROUP BY ALL HAVING count(tmk) >= 330")
Q["rollup_extremes"] = lambda s, d: rounded(rollup.extremes(rollup.read_months(s, _rolled(s, d))))
SQL["rollup_extremes"] = _over_new(f"""SELECT station, {r('heiss', 'heiss')}, min(datum) FILTER (txk = heiss) AS heiss_datum, {r('kalt', 'kalt')}, min(datum) FILTER (tnk = kalt) AS kalt_datum
FROM (SELECT station, datum, txk, tnk, max(txk) OVER (PARTITION BY station) AS heiss, min(tnk) OVER (PARTITION BY station) AS kalt FROM c) GROUP BY station, heiss, kalt""")
