import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from isotherm.functions.symbols import with_symbol
from isotherm.operators import forecast as H
from isotherm.sources import forecasts as J
from isotherm.streaming.alerts import stream_alerts

FC = ("ort int, modell string, zeit timestamp, temp double, wolken double, regen double, wind double, boe double, "
      "symbol string, ist_tag boolean, wkt double")


def at(text):
    return dt.datetime.fromisoformat(text)


def fc(spark, rows):
    """rows: (model, time, {values})"""
    names = ["temp", "wolken", "regen", "wind", "boe", "symbol", "ist_tag", "wkt"]
    return spark.createDataFrame([(1, m, at(t), *[None if v.get(n) is None else (v[n] if n in ("symbol", "ist_tag") else float(v[n])) for n in names])
                                  for m, t, v in rows], FC)


def z(temp, regen=0, symbol="klar", wkt=None, boe=20):
    return {"temp": temp, "wolken": 50, "regen": regen, "wind": 10, "boe": boe, "symbol": symbol, "ist_tag": True, "wkt": wkt}


def test_blend(spark):
    df = fc(spark, [("icon_d2", "2026-10-22 10:00", z(10, 1, "regen", 80)), ("icon_d2", "2026-10-22 11:00", z(12, 0, "wolkig", 20)),
                    ("gfs", "2026-10-22 10:00", z(7, 0, "bedeckt", None, None)), ("gfs", "2026-10-22 12:00", z(9, .4, "regen"))])
    a, b, c = H.ensemble_mean(df).orderBy("zeit").collect()
    assert (a.temp, round(a.regen, 1), a.boe, a.wkt, a.symbol) == (9, 0.7, 20, 80, "regen")
    assert (a.n, a.tmin, a.tmax, a.rmin, a.rmax) == (2, 7, 10, 0, 1)
    assert (b.temp, b.n, c.symbol) == (12, 1, "regen")


@pytest.mark.parametrize("weights, want", [
    ({"regen": 1, "bedeckt": 1}, "regen"), ({"regen": 1, "bedeckt": 2}, "bedeckt"),
    ({"regen": 1, "gewitter": 1, "wolkig": 2}, "gewitter"), ({"heiter": 1, "wolkig": 1}, "wolkig")])
def test_majority(spark, weights, want):
    rows = [(f"m{i}", "2026-01-01 00:00", {"symbol": s}) for i, s in enumerate(s for s, n in weights.items() for _ in range(n))]
    assert H.majority_symbol(fc(spark, rows)).collect()[0].symbol == want


def test_six_hour_rows_fall_away(spark):
    rows = [("metno", f"2026-10-22 {h}:00", z(5)) for h in ("10", "11", "12", "18")]
    assert [r.zeit.hour for r in H.ensemble_mean(fc(spark, rows)).orderBy("zeit").collect()] == [10, 11]


def test_daily_values(spark):
    start = at("2026-10-20 22:00")
    rows = []
    for i in range(26):
        rows.append(("m", (start + dt.timedelta(hours=i)).isoformat(" "), {
            "temp": 14 if i == 15 else 2 if i == 5 else 8, "regen": 1.2 if i == 3 else .5 if i == 20 else 0, "wind": 30 if i == 10 else 10,
            "boe": 55 if i == 11 else None, "symbol": "schnee" if i == 3 else "regen" if i == 20 else "bedeckt"}))
    a, b = H.daily_values(fc(spark, rows)).orderBy("tag").collect()
    assert (str(a.tag), a.von, a.bis, a.luecken, a.max, a.max_h, a.min, a.min_h) == ("2026-10-21", 0, 23, False, 14, 15, 2, 5)
    assert a.mittel == pytest.approx((8 * 22 + 16) / 24) and a.regen == pytest.approx(1.7)
    assert (a.arten, a.wind, a.wind_h, a.boe, a.boe_h) == (["Regen", "Schnee"], 30, 10, 55, 11)
    assert (b.von, b.bis, b.boe) == (0, 1, None)
    rows = [("m", "2026-10-21 04:00", {"temp": 5, "regen": 0, "boe": 9}), ("m", "2026-10-21 05:00", {"temp": 9, "regen": 0, "boe": 9}),
            ("m", "2026-10-21 12:00", {"temp": 9, "boe": 9}), ("m", "2026-10-21 13:00", {"regen": 3, "symbol": "regen"})]
    t = H.daily_values(fc(spark, rows)).collect()[0]
    assert (t.max, t.max_h, t.boe_h, t.luecken, t.regen, t.arten, t.von, t.bis) == (9, 7, 6, True, 0, [], 6, 14)


def series(model, start, n, temp):
    return [(model, (at(start) + dt.timedelta(hours=i)).isoformat(" "), {"temp": temp + i * .1, "regen": .2}) for i in range(n)]


def test_short_range(spark):
    df = fc(spark, series("icon_eu", "2026-10-20 00:00", 72, 5) + series("icon_d2", "2026-10-20 00:00", 40, 8))
    now = at("2026-10-20 18:30")
    rows = H.short_range(df, now).orderBy("zeit").collect()
    today = [r for r in rows if str(r.tag) == "2026-10-20"]
    tomorrow = [r for r in rows if str(r.tag) == "2026-10-21"]
    assert [r.h for r in today] == [20, 21, 22, 23] and len(tomorrow) == 24
    spare = {r.h: r.ersatz for r in tomorrow}
    assert (spare[17], spare[18]) == (None, "icon_eu")
    assert H.short_range(df, now, "icon_eu").where("ersatz IS NOT NULL").count() == 0
    days = H.short_range_days(df, now).orderBy("tag").collect()
    assert [str(d.tag) for d in days] == ["2026-10-20", "2026-10-21", "2026-10-22"]
    assert days[1].min == min(r.temp for r in tomorrow)


def part(spark, rows):
    """rows: (hour, symbol, rain, probability)"""
    df = spark.createDataFrame([(1, dt.date(2026, 1, 1), h, dt.datetime(2026, 1, 1, h), 10.0, float(r), 10.0, 20.0 + h, s, True, None if w is None else float(w))
                                for h, s, r, w in rows], "ort int, tag date, h int, zeit timestamp, temp double, regen double, wind double, boe double, symbol string, ist_tag boolean, wkt double")
    return H.day_parts(df)


@pytest.mark.parametrize("rows, want", [
    ([(9, "klar", 0, None), (10, "klar", 0, None), (11, "wolkig", 0, None)], ("klar", "trocken")),
    ([(15, "heiter", 0, None), (16, "bedeckt", 0, None)], ("bedeckt", "trocken")),
    ([(6, "regen", .8, 90), (7, "niesel", .2, 70), (8, "bedeckt", 0, 40)], ("regen", "anhaltend")),
    ([(0, "wolkig", 0, None), (1, "schauer", .3, None), (2, "heiter", 0, None), (3, "wolkig", 0, None)], ("schauer", "zeitweise")),
    ([(9, "bedeckt", 0, 20), (10, "bedeckt", 0, 55)], ("schauer", "möglich")),
    ([(12, "bedeckt", .4, None), (13, "bedeckt", .2, None)], ("regen", "anhaltend")),
    ([(18, "regen", 2, None), (19, "gewitter", 5, None), (20, "wolkig", 0, None)], ("gewitter", "anhaltend")),
    ([(0, "schnee", .5, None), (1, "schnee", .4, None), (2, "bedeckt", 0, None)], ("schnee", "anhaltend")),
    ([(0, "schneeschauer", .5, None), (1, "bedeckt", 0, None), (2, "bedeckt", 0, None)], ("schneeschauer", "zeitweise")),
    ([(0, "niesel", .1, None), (1, "niesel", .1, None)], ("niesel", "anhaltend"))])
def test_day_part_symbol(spark, rows, want):
    r = part(spark, rows).where("NOT leer").collect()[0]
    assert (r.symbol, r.art) == want


def test_day_parts_empty_ones(spark):
    rows = part(spark, [(h, "bedeckt", 0, None) for h in range(10, 24)]).orderBy("nr").collect()
    assert [r.leer for r in rows] == [True, True, False, False, False, False, False] and rows[2].ab == 10


def test_raster_and_alerts(spark):
    now = at("2026-10-20 18:30")
    main = fc(spark, series("a", "2026-10-19 22:00", 30, 0))
    spare = fc(spark, series("b", "2026-10-19 22:00", 80, 100))
    rows = H.three_hour_raster(main, spare, now).orderBy("tag_nr", "h").collect()
    assert len(rows) == 24 and [r.temp is None for r in rows[:8]] == [True] * 6 + [False] * 2
    assert rows[7].ersatz is False and rows[-1].ersatz is True and rows[0].tag_min == 0 and rows[0].tag_max == pytest.approx(2.3)
    df = fc(spark, [("a", "2026-10-20 17:00", z(1, boe=200)), ("a", "2026-10-20 18:00", z(1, 16, "gewitter", boe=80)), ("a", "2026-10-20 20:00", z(1, 15, "gewitter", boe=80)),
                    ("a", "2026-10-21 18:00", z(1, boe=90)), ("a", "2026-10-21 19:00", z(1, 99))])
    alerts = H.severe_weather(df, now)
    assert {(r.art, r.wert, r.zeit.hour, str(r.tag)) for r in alerts.collect()} == {
        ("sturm", 90.0, 18, "2026-10-21"), ("regen", 16.0, 18, "2026-10-20"), ("gewitter", None, 18, "2026-10-20")}
    known = spark.createDataFrame([(1, "regen", dt.date(2026, 10, 20))], "ort int, art string, tag date")
    assert {r.art for r in H.new_alerts(alerts, known).collect()} == {"sturm", "gewitter"}


def test_alert_stream_reports_a_day_once(spark, tmp_path):
    def arrive(name, rows):
        fc(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        hours = spark.readStream.schema(FC).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = stream_alerts(hours).writeStream.format("parquet").option("path", str(tmp_path / "out")) \
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.art, str(r.tag), r.zeit.hour) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = arrive("1", [("a", "2026-10-20 10:00", z(1, boe=80)), ("a", "2026-10-20 11:00", z(1, symbol="gewitter"))])
    assert first == [("gewitter", "2026-10-20", 11), ("sturm", "2026-10-20", 10)]
    second = arrive("2", [("a", "2026-10-20 12:00", z(1, boe=99)), ("a", "2026-10-21 12:00", z(1, boe=99))])
    assert second == sorted(first + [("sturm", "2026-10-21", 12)])
    arrive("3", [("a", "2026-10-30 12:00", z(1))])
    late = arrive("4", [("a", "2026-10-22 12:00", z(1, boe=99))])
    assert late == second, "hours behind the watermark are dropped"


def test_symbols(spark):
    df = spark.createDataFrame([("partlycloudy_night",), ("heavyrainandthunder",), ("fog",), ("rain",), ("",), (None,)], "symbol_code string")
    assert [(r.symbol, r.ist_tag) for r in with_symbol(df, "text").collect()] == [
        ("wolkig", False), ("gewitter", None), ("nebel", None), ("regen", None), (None, None), (None, None)]
    df = spark.createDataFrame([(0,), (66,), (97,), (4,), (None,)], "weather_code int")
    assert [r.symbol for r in with_symbol(df, "wmo").collect()] == ["klar", "glatteis", "gewitter", None, None]
    df = spark.createDataFrame([("partly-cloudy-night",), ("hail",)], "icon string")
    assert [(r.symbol, r.ist_tag) for r in with_symbol(df, "icon").collect()] == [("wolkig", False), ("gewitter", None)]


def test_answers(spark):
    one = {"hourly": {"time": ["2026-10-20T00:00", "2026-10-20T01:00", "2026-10-20T02:00"], "temperature_2m": [5.25, None, 7.0],
                      "cloud_cover": [80, None], "weather_code": [3, 0, 61], "is_day": [0, 1, 1]}}
    df = spark.createDataFrame([(1, "a", json.dumps(one)), (1, "b", json.dumps({"error": True, "reason": "x request limit y"})), (1, "c", "{}")],
                               "ort int, modell string, antwort string")
    rows, errors = J.read_forecast(df)
    assert [(r.zeit.hour, r.temp, r.wolken, r.symbol, r.ist_tag) for r in rows.orderBy("zeit").collect()] == [
        (0, 5.2, 80.0, "bedeckt", False), (2, 7.0, None, "regen", True)]
    assert {r.modell: r.fehler for r in errors.collect()} == {"b": J.LIMIT_TEXT, "c": J.EMPTY_TEXT}
    entry = {"time": "2026-10-20T00:00:00Z", "data": {"instant": {"details": {"air_temperature": 4.0, "wind_speed": 10}},
             "next_6_hours": {"summary": {"symbol_code": "rain"}, "details": {"precipitation_amount": 20.0}}}}
    df = spark.createDataFrame([(1, "metno", json.dumps({"properties": {"timeseries": [entry] * 80}})), (2, "metno", "{}")], "ort int, modell string, antwort string")
    rows, errors = J.read_timeseries(df, 72)
    r = rows.collect()
    assert len(r) == 72 and (r[0].wind, r[0].symbol, r[0].regen, r[0].sechs_stunden) == (36.0, "regen", 20.0, True)
    assert [(e.ort, e.fehler) for e in errors.collect()] == [(2, "keine Werte")]
    current = {"weather": {"source_id": 2, "temperature": 3.14, "icon": "clear-day"}, "sources": [{"id": 1, "station_name": "A", "distance": 900}, {"id": 2, "station_name": "B", "distance": 1250}]}
    df = spark.createDataFrame([(1, json.dumps(current)), (2, "{}")], "ort int, antwort string")
    a, b = J.read_current(df).orderBy("ort").collect()
    assert (a.temp, a.symbol, a.ist_tag, a.station, a.abstand, a.fehler) == (3.1, "klar", True, "B", 1.2, None)
    assert b.fehler is not None


def test_rounding_takes_the_exact_binary_value(spark):
    import random

    from isotherm.functions.numbers import rounded

    rng = random.Random(4)
    values = [0.15, 0.25, 0.35, -0.15, -0.25, -0.05, 2.675, 1e6 + 0.05, 0.0, 12.0, -7.5] + [rng.randint(-4000, 4000) / 20 for _ in range(400)]
    values += [rng.uniform(-50, 50) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", rounded(F.col("v"), 1).alias("a"), rounded(F.col("v"), 0).alias("b"))
    for r in df.collect():
        assert (r.a, r.b) == (round(r.v, 1), round(r.v, 0)), r.v
