import base64
import datetime as dt
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from isotherm.functions.sky import sun_elevation, with_daylight, with_grid, with_lonlat, with_rain_class
from isotherm.operators import geo as G, radar as B, search as X
from isotherm.sources import gazetteer
from isotherm.sources.frames import read_frames

D = dt.date
ST = "id int, name string, land string, hoehe int, lat double, lon double, von date, bis date"
PT = "id int, lat double, lon double, hoehe int"


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def test_nearest_and_closed(spark):
    st = spark.createDataFrame([(1691, "Mitte", "N", 167, 51.5002, 9.9507, D(1857, 1, 1), D(2026, 10, 19)),
                                (2014, "Nord", "N", 55, 52.4644, 9.6779, D(1936, 1, 1), D(2026, 10, 19)),
                                (9999, "Alt", "N", 150, 51.53, 9.93, D(1900, 1, 1), D(1990, 12, 31)),
                                (8888, "ohne", "x", 0, None, None, D(1900, 1, 1), D(2026, 10, 19))], ST)
    p = spark.createDataFrame([(1, 51.533, 9.935, None)], PT)
    r = G.nearest_station(p, st, True, 2026).collect()[0]
    assert r.station == 1691 and r.km < 5
    assert G.nearest_station(p, st, False).collect()[0].station == 9999
    pair = spark.createDataFrame([(1, 1691, 51.5002, 9.9507, 52.4644, 9.6779)], "a int, b int, p double, q double, r double, s double")
    assert G.with_distance(pair, "p", "q", "r", "s").collect()[0].km == pytest.approx(108.8, abs=1)


def test_suitable(spark):
    end = D(2026, 10, 20)
    st = spark.createDataFrame([(1, "Tal", "X", 230, 51.80, 10.70, D(1950, 1, 1), end), (2, "Berg", "X", 1134, 51.80, 10.62, D(1947, 1, 1), end),
                                (3, "Neu", "X", 1100, 51.799, 10.616, D(2010, 1, 1), end), (4, "Alt", "X", 1100, 51.799, 10.616, D(1900, 1, 1), D(1990, 12, 31)),
                                (5, "Mitte", "X", 700, 51.85, 10.62, D(1960, 1, 1), end)], ST)
    p = spark.createDataFrame([(1, 51.7991, 10.6157, 1130)], PT)
    r = G.suitable_stations(p, st, 3, 2026).orderBy("nr").collect()
    assert [x.station for x in r] == [2, 5, 1] and r[0].dh == 4
    p = spark.createDataFrame([(1, 51.80, 10.70, None)], PT)
    assert [x.station for x in G.suitable_stations(p, st, 1, 2026).collect()] == [1]


def test_nearest_against_brute_force_over_the_globe(spark):
    rng = random.Random(11)
    spots = [(rng.gauss(50, 2), rng.gauss(10, 3)) for _ in range(150)] + [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(50)]
    spots += [(51.0, 179.9), (60.0, -179.8), (88.9, 20.0)]
    st = [(i, "s", "l", rng.randrange(0, 3000), a, b, D(1950, 1, 1), D(2026, 1, 1)) for i, (a, b) in enumerate(spots)]
    pts = [(i, rng.gauss(50, 3), rng.gauss(10, 4), rng.randrange(0, 3000)) for i in range(150)]
    pts += [(i, rng.uniform(-89.5, 89.5), rng.uniform(-180, 180), rng.randrange(0, 3000)) for i in range(150, 260)]
    pts += [(260, 51.0, -179.9, 10), (261, 59.0, 179.9, 10), (262, 89.0, -160.0, 10), (263, 0.0, 0.0, 0)]
    sdf, pdf = spark.createDataFrame(st, ST), spark.createDataFrame(pts, PT)
    got = {r.punkt: (r.station, r.km) for r in G.nearest_station(pdf, sdf, False).collect()}
    assert len(got) == len(pts)
    for i, a, b, h in pts:
        best = min((km(a, b, s[4], s[5]), s[0]) for s in st)
        assert got[i][1] == pytest.approx(best[0], abs=1e-6)
    cost = {}
    for r in G.suitable_stations(pdf, sdf, 3, 2026).collect():
        cost.setdefault(r.punkt, []).append(r.wert)
    for i, a, b, h in pts:
        best = sorted(km(a, b, s[4], s[5]) + abs(s[3] - h) / 10 for s in st)[:3]
        assert sorted(cost[i]) == pytest.approx(best, abs=1e-6)


def test_place_name(spark):
    places = spark.createDataFrame([(1, "Dorf", False, 51.5, 9.9), (2, "Spitze", True, 51.503, 9.9), (3, "Weit", False, 52.5, 9.9)],
                                   "id int, name string, gipfel boolean, lat double, lon double")
    p = spark.createDataFrame([(1, 51.5, 9.9, None), (2, 51.495, 9.9, None), (3, 51.53, 9.9, None), (4, 10.0, 9.9, None)], PT)
    assert {r.punkt: r.name for r in G.place_name(p, places).collect()} == {1: "Spitze", 2: "Dorf", 3: "bei Dorf"}


def test_grid(spark):
    df = spark.createDataFrame([(1, 9.95, 51.5), (2, 10.6157, 51.7991), (3, 6.1, 47.3), (4, 14.9, 54.9)], "id int, lon double, lat double")
    placed = with_grid(df)
    r = placed.where("id = 1").collect()[0]
    assert (r.gx, r.gy) == (pytest.approx(539.563, abs=.002), pytest.approx(541.829, abs=.002))
    back = {r.id: (r.lon, r.lat) for r in with_lonlat(placed.select("id", "gx", "gy")).collect()}
    for r in df.collect():
        assert back[r.id] == pytest.approx((r.lon, r.lat), abs=1e-6)


def test_windows(spark):
    p = spark.createDataFrame([(1, 539.6, 541.8)], "id int, gx double, gy double")
    assert tuple(B.windows_around(p, 100).collect()[0])[1:] == (492, 490, 592, 590)
    p = spark.createDataFrame([(1, 10.0, 1190.0)], "id int, gx double, gy double")
    assert tuple(B.windows_around(p, 250).collect()[0])[1:] == (949, 0, 1199, 250)
    assert tuple(B.windows_around(p, None).collect()[0])[1:] == (0, 0, 1199, 1099)
    with pytest.raises(ValueError):
        B.check_bbox((0, 0, 1200, 10))


def test_crop_around_is_whole(spark):
    rng = random.Random(7)
    t = [dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, 0, 5), None]
    px = [(rng.randrange(395, 440), rng.randrange(295, 345), rng.choice(t), n % 900, n % 3) for n in range(700)]
    px += px[:30] + [(None, 300, t[0], 1, 1), (400, None, t[0], 2, 2), (-1, 300, t[0], 3, 3), (5000, 300, t[1], 4, 4)]
    pt = [(n % 310, rng.uniform(300, 335), rng.uniform(400, 430)) for n in range(330)] + [(None, 310.0, 410.0), (1, None, 410.0), (2, 310.0, None), (3, -9.0, 2000.0)]
    frames = spark.createDataFrame(px, "zeile int, spalte int, timestamp timestamp, by int, wert int").repartition(3)
    for km in (1, 60, None):
        points = spark.createDataFrame(pt if km else pt[::20], "id int, gx double, gy double").repartition(3)
        boxes = [tuple(r) for r in B.windows_around(points, km).collect()]
        # a pixel without a frame is in none; without frames at all there is no such column
        for pixels, held in ((frames, [p for p in px if p[2]]), (frames.drop("timestamp"), px)):
            got = B.crop_around(pixels, points, km)
            order = [pixels.columns.index(c) for c in got.columns[:-1]]
            plain = [(*p[:2], *p[3:]) if "timestamp" not in pixels.columns else p for p in held]
            want = Counter((*(p[i] for i in order), i_d) for p in plain for i_d, o, li, u, re in boxes
                           if None not in (o, li, p[0], p[1]) and o <= p[0] <= u and li <= p[1] <= re)
            assert got.columns == [*(["timestamp"] if "timestamp" in pixels.columns else []), *(c for c in pixels.columns if c != "timestamp"), "id"]
            assert Counter(tuple(r) for r in got.collect()) == want


def test_crop_around_is_stored_as_runs(spark, tmp_path):
    """The rows grow with pixels times windows; the bytes of most of them are to be runs and repeats."""
    rng = random.Random(8)
    px = [(n, rng.randrange(400, 464), rng.randrange(300, 364)) for n in rng.sample(range(10**9), 2000)]
    pt = [(n, rng.uniform(290, 370), rng.uniform(390, 470)) for n in rng.sample(range(10**9), 1500)]
    got = B.crop_around(spark.createDataFrame(px, "nr long, zeile int, spalte int"), spark.createDataFrame(pt, "id int, gx double, gy double"), 60)
    got.write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    assert rows > 800_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.8 * rows


def test_frames_and_classes(spark):
    packed = base64.b64encode(zlib.compress(bytes([0, 0, 10, 0, 1, 1, 209, 0]))).decode()
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1), packed)], "timestamp timestamp, precipitation_5 string")
    rows = with_rain_class(read_frames(df, (5, 7, 6, 8))).orderBy("zeile", "spalte").collect()
    assert [(r.zeile, r.spalte, r.raw, r.klasse) for r in rows] == [(5, 7, 0, None), (5, 8, 10, 2), (6, 7, 257, 6), (6, 8, 209, 6)]
    assert rows[1].mm_h == pytest.approx(1.2)


def test_sampled_frames(spark):
    start = dt.datetime(2026, 10, 20, 20, 0)
    df = spark.createDataFrame([(start + dt.timedelta(minutes=5 * i),) for i in range(200)], "timestamp timestamp")
    now = dt.datetime(2026, 10, 21, 3, 47)

    def past(h):
        return [r.timestamp for r in B.sample_frames(df, now, h).where(F.col("timestamp") < dt.datetime(2026, 10, 21, 3, 45)).orderBy("timestamp").collect()]
    assert len(past(6)) == 24 and past(6)[0] == dt.datetime(2026, 10, 20, 21, 45) and past(6)[-1] == dt.datetime(2026, 10, 21, 3, 30)
    assert past(3)[0] == dt.datetime(2026, 10, 21, 0, 40) and past(1)[0] == dt.datetime(2026, 10, 21, 2, 45)
    assert B.sample_frames(df, now, 6).agg(F.max("timestamp")).collect()[0][0] == dt.datetime(2026, 10, 21, 5, 45)


def test_search(spark):
    places = spark.createDataFrame([(1, "Bad Harzburg", 20, False, 1), (2, "Harz", 5, False, 1), (3, "Harzgerode", 9, False, 1),
                                    (4, "Oberharz", 99, False, 1), (5, "Neu-Harz", 3, False, 1)], "id int, name string, einwohner int, gipfel boolean, hoehe int")
    q = spark.createDataFrame([(1, "harz"), (2, " bad harz"), (3, "  "), (4, "o")], "anfrage int, text string")
    got = {}
    for r in X.search_places(q, places).orderBy("nr").collect():
        got.setdefault(r.anfrage, []).append(r.id)
    assert got[1] == [2, 3, 1, 5, 4] and got[2] == [1] and 3 not in got and set(got[4]) == {4, 3}
    st = spark.createDataFrame([(44, "Zell", "Bayern", 0), (144, "Ahr 44", "Bayern", 0), (3, "Ähtä", "Hessen", 0), (4, "Bad", "Hessen", 0)], "id int, name string, land string, hoehe int")
    q = spark.createDataFrame([(1, "44"), (2, "hessen"), (3, "bay ze")], "anfrage int, text string")
    got = {}
    for r in X.search_stations(q, st).orderBy("nr").collect():
        got.setdefault(r.anfrage, []).append((r.rang, r.id))
    assert got == {1: [(0, 44), (2, 144)], 2: [(4, 3), (4, 4)], 3: [(4, 44)]}


def test_search_sends_no_texts_round(spark, tmp_path):
    spark.range(50).selectExpr("cast(id as int) id", "concat('Ort ', id) name", "1 einwohner", "false gipfel", "1 hoehe").write.parquet(str(tmp_path / "p"))
    places = spark.read.parquet(str(tmp_path / "p"))
    q = spark.createDataFrame([(1, "ort 7")], "anfrage int, text string")
    found = X.search_places(q, places)
    plan = found._jdf.queryExecution().executedPlan().toString()
    sent = [part for part in plan.split("BroadcastExchange")[1:] if "einwohner" in part.split("Exchange")[0]]
    assert not sent and "SortMergeJoin [id" in plan
    assert [r.id for r in found.collect()] == [7, 17, 27, 37, 47]


def test_gazetteer_and_cities(spark, tmp_path):
    def row(i, name, cls, code, state, people, h, model):
        cells = [""] * 19
        cells[0], cells[1], cells[4], cells[5], cells[6], cells[7], cells[10], cells[14], cells[15], cells[16] = str(i), name, "51.5", "9.9", cls, code, state, people, h, model
        return "\t".join(cells)
    (tmp_path / "d.txt").write_text("\n".join([row(1, 'A "x"', "P", "PPL", "06", "100", "", "150"), row(2, "B", "P", "PPLH", "06", "9", "", "1"), row(3, "C", "T", "PK", "14", "", "", "1141"),
                                               row(4, "D", "P", "PPL", "99", "9", "", "1"), row(5, "E", "P", "PPL", "01", "", "-9999", "7"), row(6, "F", "S", "X", "01", "", "", "")]), encoding="utf-8")
    rows = gazetteer.read_places(spark, str(tmp_path / "d.txt")).collect()
    assert [(r.name, r.land, r.hoehe, r.einwohner, r.gipfel, r.lat_m) for r in rows] == [
        ('A "x"', "Niedersachsen", 150, 100, False, 51500), ("C", "Sachsen-Anhalt", 1141, 0, True, 51500), ("E", "Baden-Württemberg", None, 0, False, 51500)]
    import json
    f = lambda n, c, p, cap, lon, lat: {"type": "Feature", "properties": {"NAME": n, "ADM0_A3": c, "POP_MAX": p, "ADM0CAP": cap, "LONGITUDE": lon, "LATITUDE": lat}}
    (tmp_path / "c.json").write_text(json.dumps({"features": [f("klein", "DEU", 99999, 0, 9, 51), f("mittel", "DEU", 100000, 0, 9, 51), f("gross", "DEU", 300000, 0, 9, 51),
                                                             f("haupt", "XXX", 10, 1, 9, 50), f("fern", "XXX", 9e6, 0, 100, 0)]}))
    assert [(r.name, r.rang) for r in gazetteer.read_cities(spark, str(tmp_path / "c.json")).collect()] == [("haupt", 1), ("gross", 2), ("mittel", 3)]


def test_daylight(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 6, 21, 11), 51.5, 9.9, None), (dt.datetime(2026, 12, 21, 17), 51.5, 9.9, None),
                                (dt.datetime(2026, 12, 21, 17), None, None, None), (dt.datetime(2026, 6, 21, 11), 51.5, 9.9, False)],
                               "zeit timestamp, lat double, lon double, ist_tag boolean")
    assert [r.hell for r in with_daylight(df).collect()] == [True, False, True, False]
    high = df.limit(1).select(sun_elevation(F.unix_timestamp("zeit"), F.col("lat"), F.col("lon")).alias("h")).collect()[0].h
    assert high == pytest.approx(90 - 51.5 + 23.44, abs=.5)


def _most_joined(df):
    """Most rows that a join of the plan made, after running it."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if "Join" in name:
                most = max(most, node.metrics().get("numOutputRows").get().value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_dense_stations_are_not_all_met(spark):
    rng = random.Random(5)
    st = [(i, "s", "l", rng.randrange(0, 900), rng.uniform(50.01, 50.24), rng.uniform(10.01, 10.24), D(1950, 1, 1), D(2026, 1, 1)) for i in range(1500)]
    pts = [(i, rng.uniform(50.01, 50.24), rng.uniform(10.01, 10.24), rng.choice((None, rng.randrange(0, 900)))) for i in range(150)]
    sdf, pdf = spark.createDataFrame(st, ST), spark.createDataFrame(pts, PT)
    everything = len(st) * len(pts)
    near = G.nearest_station(pdf, sdf, False)
    assert _most_joined(near) < everything / 4
    assert {r.punkt: r.km for r in near.collect()} == {i: pytest.approx(min(km(a, b, s[4], s[5]) for s in st), abs=1e-6) for i, a, b, h in pts}
    places = sdf.selectExpr("id", "name", "id % 9 = 0 gipfel", "lat", "lon")
    assert _most_joined(G.place_name(pdf, places)) < everything / 4
    named = {r.punkt: r.ort for r in G.place_name(pdf, places).collect()}
    for i, a, b, h in pts:
        by = sorted((km(a, b, s[4], s[5]), s[0]) for s in st)
        peak = [x for x in by if x[1] % 9 == 0 and x[0] < 0.5]
        assert named[i] == (peak or [x for x in by if x[1] % 9])[0][1]


def test_place_name_beyond_the_nearest_one_outside_the_box(spark):
    # 1 is nearer but 151 thousandths to the north; 2 lies in the corner of the box
    places = spark.createDataFrame([(1, "Nord", False, 50.151, 10.0), (2, "Ecke", False, 50.14, 10.24)], "id int, name string, gipfel boolean, lat double, lon double")
    p = spark.createDataFrame([(1, 50.0, 10.0, None)], PT)
    assert [(r.ort, r.name) for r in G.place_name(p, places).collect()] == [(2, "bei Ecke")]
