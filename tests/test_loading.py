import datetime as dt
import io
import zipfile

from isotherm.operators import ingest as I
from isotherm.plans import store
from isotherm.schema import PRODUCT_FIELDS
from isotherm.sources import daily, listings
from isotherm.streaming.recent import failed_arrivals, stream_recent

D = dt.date
NAMES = sorted(PRODUCT_FIELDS)
USUAL = {"FX": 4.25, "NM": 3, "QN_4": 10, "QN_3": 3}


def product(sid, days):
    """A product file, fields in alphabetical order. days: (date, TMK, TXK, TNK, QN_4), the last may be left out."""
    text = ";".join(["STATIONS_ID", "MESS_DATUM", *NAMES]) + "\r\n"
    for date, *given in days:
        values = USUAL | {k: v for k, v in zip(("TMK", "TXK", "TNK", "QN_4"), given) if v is not None}
        text += ";".join([str(sid), date.strftime("%Y%m%d"), *(f" {values.get(n, -999)}" for n in NAMES)]) + "\r\n"
    return text.encode("latin-1")


def archive(text):
    with io.BytesIO() as data:
        with zipfile.ZipFile(data, "w") as packed:
            for name, content in (("produkt_klima_tag_x_y.txt", text), ("readme.txt", b"-")):
                packed.writestr(name, content)
        return data.getvalue()


def test_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(product(1, [(D(1858, 1, 1), None), (D(1950, 1, 2), 7.8, 8.9, 6.9, 5)]))
    (tmp_path / "b.txt").write_bytes(b"STATIONS_ID;MESS_DATUM;TNK;TXK;TMK;eor\r\n2;20000101; 1.5; 3;-999;eor\r\n2;        ;1;1;1;eor\r\n")
    (tmp_path / "c.txt").write_bytes(b"A;B;C\r\n1;2;3\r\n")
    (tmp_path / "d.txt").write_bytes(product(4, [(D(2000, 1, 1), 1.0)]).replace(b" 3;", b" abc;"))
    (tmp_path / "e.txt").write_bytes(b"MESS_DATUM;TMK;TXK;TNK\r\n20000101;1;2;0\r\n")
    (tmp_path / "f.txt").write_bytes(b"STATIONS_ID;MESS_DATUM;TMK;TXK;TNK\r\n7;20000101;1;2;0\r\n ;20000102;1;2;0\r\n")
    good, failed = daily.read_daily(spark, str(tmp_path))
    rows = [(r.station, r.datum, r.tmk, r.txk, r.tnk, r.qn, r.fx) for r in good.orderBy("station", "datum").collect()]
    assert rows == [(1, D(1858, 1, 1), None, None, None, 10, 4.25), (1, D(1950, 1, 2), 7.8, 8.9, 6.9, 5, 4.25),
                    (2, D(2000, 1, 1), None, 3.0, 1.5, None, None)]
    bad = {r.path[-5:]: r.fehler for r in failed.collect()}
    assert set(bad) == {"c.txt", "d.txt", "e.txt", "f.txt"} and bad["e.txt"].startswith("unexpected header") and bad["f.txt"].startswith("unreadable line") and bad["c.txt"].startswith("unexpected header") and bad["d.txt"].startswith("unreadable line")


def test_archives_good_and_broken(spark, tmp_path):
    (tmp_path / "k_00001_hist.zip").write_bytes(archive(product(1, [(D(2000, 1, 1), 5.0)])))
    (tmp_path / "k_00002_akt.zip").write_bytes(archive(product(2, [(D(2026, 1, 1), 3.0)])))
    (tmp_path / "k_00003_akt.zip").write_bytes(b"not a zip")
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("other.txt", "x")
    (tmp_path / "k_00004_akt.zip").write_bytes(empty.getvalue())
    good, failed = daily.read_archives(spark, str(tmp_path))
    assert sorted((r.station, r.quelle, r.tmk) for r in good.collect()) == [(1, 0, 5.0), (2, 1, 3.0)]
    assert sorted(r.path[-11:-8] for r in failed.collect()) == ["003", "004"]


STATIONS = (
    "Stations_id von_datum bis_datum Stationshoehe geoBreite geoLaenge Stationsname Bundesland Abgabe\n"
    "----------- --------- --------- ------------- --------- --------- ----- ----- -----\n"
    "00001 19370101 19860630            478     47.8413    8.8493 Aach                                     Baden-Württemberg                        Frei\n"
    "01234 19500101 20261019         167.9     51.5002    9.9507 Bad Lippspringe           Nordrhein-Westfalen        Frei\n"
    "kaputt\n").encode("latin-1")


def test_station_list(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes(STATIONS)
    rows = listings.read_stations(spark, str(tmp_path / "l.txt")).orderBy("id").collect()
    assert [(r.id, r.name, r.land, r.hoehe, r.von) for r in rows] == [
        (1, "Aach", "Baden-Württemberg", 478, D(1937, 1, 1)), (1234, "Bad Lippspringe", "Nordrhein-Westfalen", 167, D(1950, 1, 1))]


def test_listing_last_link_wins(spark):
    html = ''.join(f'<a href="tageswerte_KL_{i}_hist.zip">x</a>' for i in ("01691_18580101_20241231", "00044_20070401_20251231", "01691_18580101_20251231"))
    pages = spark.createDataFrame([(1, html), (2, '<a href="tageswerte_KL_00044_akt.zip">')], "seite int, html string")
    assert {r.station: r.datei for r in listings.archive_manifest(pages).collect()} == {
        44: "tageswerte_KL_00044_20070401_20251231_hist.zip", 1691: "tageswerte_KL_01691_18580101_20251231_hist.zip"}
    assert [r.station for r in listings.active_stations(pages).collect()] == [44]


def day(sid, d, tmk):
    return (sid, d, tmk)


def frame(spark, rows):
    return spark.createDataFrame(rows, "station int, datum date, tmk double")


def values(df):
    return [(r.station, r.datum, r.tmk) for r in df.orderBy("station", "datum").collect()]


def test_history_wins_and_refresh_touches_recent_only(spark):
    hist = frame(spark, [(1, D(2025, 12, 30), 1.0), (1, D(2025, 12, 31), 1.0)])
    recent = frame(spark, [(1, D(2025, 12, 31), 9.0), (1, D(2026, 1, 1), 3.0), (2, D(2026, 1, 1), 7.0)])
    merged = I.merge_sources(hist, recent)
    assert values(merged) == [(1, D(2025, 12, 30), 1.0), (1, D(2025, 12, 31), 1.0), (1, D(2026, 1, 1), 3.0), (2, D(2026, 1, 1), 7.0)]
    new = frame(spark, [(1, D(2026, 1, 1), 3.5), (1, D(2026, 1, 2), 5.0)])
    once = I.replace_recent(merged, new)
    assert values(once) == [(1, D(2025, 12, 30), 1.0), (1, D(2025, 12, 31), 1.0), (1, D(2026, 1, 1), 3.5), (1, D(2026, 1, 2), 5.0), (2, D(2026, 1, 1), 7.0)]
    assert values(I.replace_recent(once, new)) == values(once)


def test_refresh_plan_and_load_state(spark):
    manifest = spark.createDataFrame([(1, "a"), (2, "b2"), (3, "c"), (4, "d")], "station int, datei string")
    state = spark.createDataFrame([(2, "b1", 990.0), (3, "c", 0.0), (4, "d", 990.0), (5, "", 990.0), (6, "", None)],
                                  "station int, hist_datei string, recent_am double")
    plan = {r.station: r.aktion for r in I.refresh_plan(manifest, state, 1000.0, 100).collect()}
    assert plan == {1: "voll", 2: "voll", 3: "recent", 4: "nichts", 5: "nichts", 6: "recent"}
    loads = spark.createDataFrame([(2, "b2", 1000.0), (3, None, 1000.0), (7, "g", None)], state.schema)
    after = {r.station: (r.hist_datei, r.recent_am) for r in I.update_load_state(state, loads).collect()}
    assert after == {2: ("b2", 1000.0), 3: ("c", 1000.0), 4: ("d", 990.0), 5: ("", 990.0), 6: ("", None), 7: ("g", None)}
    files = spark.createDataFrame([("a.zip",), ("alt.zip",), ("x.txt",)], "datei string")
    active = spark.createDataFrame([(1,)], "station int")
    kept = spark.createDataFrame([(1, "a.zip"), (9, "alt.zip")], "station int, datei string")
    assert [r.datei for r in I.obsolete_archives(files, kept, active).collect()] == ["alt.zip"]


NOW = dt.datetime(2026, 6, 1, 12)


def expired(spark, rows, **options):
    data = [(i, g, NOW - dt.timedelta(days=a), s) for i, g, a, s in rows]
    df = spark.createDataFrame(data, "id int, gruppe int, erstellt timestamp, status string")
    return sorted(r.id for r in I.expired(df, NOW, **options).collect())


def test_retention(spark):
    done = "completed"
    assert expired(spark, [(100 + i, 1, 100 + i, done) for i in range(9)]) == [105, 106, 107, 108]
    rows = [(200 + i, 1, 20 + i, done) for i in range(8)] + [(300 + i, 2, 60 + 30 * i, done) for i in range(3)]
    assert expired(spark, rows) == [205, 206, 207]
    young = [(400 + i, 1, i, done) for i in range(12)]
    assert expired(spark, young) == []
    assert expired(spark, young, days=7) == [408, 409, 410, 411]
    rows = [(500 + i, 1, 100 + i, done) for i in range(6)] + [(599, 1, 200, "in_progress"), (598, 1, 300, "queued")]
    assert expired(spark, rows) == [505]
    assert expired(spark, [(600 + i, 1, 400 + i, done) for i in range(3)]) == []
    assert expired(spark, [(i, 1, 50, done) for i in range(7)]) == [0, 1], "of equal times the lower id goes"


def test_freshest(spark):
    df = spark.createDataFrame([(1, "2026-01-01", 5, "a"), (1, "2026-01-02", 1, "b"), (1, "2026-01-02", 2, "c")],
                               "art int, stand string, erstellt int, wert string")
    assert [r.wert for r in I.freshest(df, "art").collect()] == ["c"]


def test_build_refresh_and_stream(spark, tmp_path):
    for kind, sid, rows in (("h", 1, [(D(2025, 12, 30), 1.0), (D(2025, 12, 31), 1.0)]), ("r", 1, [(D(2025, 12, 31), 9.0), (D(2026, 1, 1), 3.0)]),
                            ("r", 2, [(D(2026, 1, 1), 4.0)])):
        name = f"k_{sid:05d}_{'hist' if kind == 'h' else 'akt'}.zip"
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / name).write_bytes(archive(product(sid, rows)))
    (tmp_path / "list.txt").write_bytes(STATIONS)
    listing = spark.createDataFrame([(1, '<a href="tageswerte_KL_00001_19370101_20251231_hist.zip">')], "seite int, html string")
    out = str(tmp_path / "out")
    made = store.build_dataset(spark, str(tmp_path / "list.txt"), listing, str(tmp_path / "h"), str(tmp_path / "r"), out)
    assert made["failed"].count() == 0 and spark.read.json(f"{out}/stations").count() == 2
    table = f"{out}/observations"
    assert values(store.read_store(spark, table)) == [(1, D(2025, 12, 30), 1.0), (1, D(2025, 12, 31), 1.0), (1, D(2026, 1, 1), 3.0), (2, D(2026, 1, 1), 4.0)]

    inbox = tmp_path / "in"
    inbox.mkdir()

    def arrive(name, rows):
        (inbox / name).write_bytes(product(1, rows))
        stream_recent(spark, str(inbox), table, str(tmp_path / "state"), str(tmp_path / "failed")).awaitTermination()
        return values(store.read_store(spark, table))

    want = [(1, D(2025, 12, 30), 1.0), (1, D(2025, 12, 31), 1.0), (1, D(2026, 1, 1), 3.5), (1, D(2026, 1, 2), 5.0), (2, D(2026, 1, 1), 4.0)]
    rows = [(D(2025, 12, 31), 8.0), (D(2026, 1, 1), 3.5), (D(2026, 1, 2), 5.0)]
    assert arrive("a.txt", rows) == want
    assert arrive("b.txt", rows) == want, "the same file again changes nothing"
    assert arrive("c.txt", [(D(2025, 12, 31), 8.0)]) == want[:2] + want[4:], "recent days that are gone are gone"

    (inbox / "d.txt").write_bytes(b"no header\r\n1;2\r\n")
    stream_recent(spark, str(inbox), table, str(tmp_path / "state"), str(tmp_path / "failed")).awaitTermination()
    failed = failed_arrivals(spark, str(tmp_path / "failed")).collect()
    assert [(r.path[-5:], r.fehler) for r in failed] == [("d.txt", "unexpected header: no header")]
