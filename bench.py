"""Headline queries; prints one JSON line.

Two parts. ``queries``: the operators on the series derived from $BENCH_SF_DIR. ``scaled``:
the same series copied to $BENCH_STATION_DAYS station-days (default 21.6 million, the size the
published numbers refer to), written once as a bucketed table, as the library stores them.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from isotherm.operators import (  # noqa: E402
    clean as C, forecast as H, geo, national as D, normals as N, outlook as P, records as R,
    series as S, totals as T, waves as W, year as Y, yearly as A,
)
from isotherm.schema import MEASURES  # noqa: E402
from isotherm.plans import rollup, store  # noqa: E402
from isotherm.session import local_session, stored  # noqa: E402
from isotherm.sources import derived  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
STATION_DAYS = int(os.environ.get("BENCH_STATION_DAYS", "21600000"))
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))
TABLE = "isotherm_bench"
TODAY = dt.date(2001, 11, 5)


def timed(df_of, repeats: int) -> float:
    """Best of the runs; every row is computed and thrown away."""
    best = None
    for _ in range(repeats):
        start = time.perf_counter()
        df_of().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        best = took if best is None else min(best, took)
    return round(best, 3)


def daily_queries(obs: DataFrame) -> dict:
    c = C.clean(obs)
    return {
        "yearly_mean": lambda: S.yearly_means(c),
        "extremes": lambda: R.extremes(c),
        "yearly_series": lambda: S.yearly_series(c),
        "stripes": lambda: A.stripes(c),
        "threshold_days": lambda: A.threshold_days(c),
        "rule_audit": lambda: C.rule_audit(obs),
        "daily_series": lambda: S.daily_series(c),
        "records": lambda: R.records(c),
        "day_normals": lambda: N.day_normals(c),
        "ytd_rank": lambda: Y.ytd_rank(c),
        "year_forecast": lambda: P.year_forecast(c, TODAY, 5),
        "forecast_trajectory": lambda: P.forecast_trajectory(c, TODAY, 5),
        "waves_fixed": lambda: W.waves(c, "fest"),
        "waves_normal": lambda: W.waves(c, "normal"),
        "rain_totals": lambda: T.yearly_totals(c, "rsk"),
        "rain_band": lambda: T.cumulative_band(c, "rsk"),
        "new_records": lambda: D.new_records(c),
        "calendar_day_records": lambda: D.calendar_day_records(c, 14, 3),
    }


def other_queries(spark: SparkSession, sf: str) -> dict:
    fc, now = derived.forecast(spark, sf), dt.datetime(2024, 1, 10, 6, 20)
    places, st = derived.places(spark, sf), derived.supplier_stations(spark, sf)
    return {
        "ensemble_mean": lambda: H.ensemble_mean(fc, ("click", "view"), six_hour_model="error"),
        "daily_values": lambda: H.daily_values(fc),
        "severe_weather": lambda: H.severe_weather(fc, now, 23.0, 5.0),
        "nearest_station": lambda: geo.nearest_station(places, st, True, 2002),
        "suitable_stations": lambda: geo.suitable_stations(places, st, 3, 2002),
    }


def scaled_store(spark: SparkSession, obs: DataFrame) -> int:
    """Copies of the series as further stations, values moved by tenths of a degree."""
    copies = max(1, STATION_DAYS // obs.count())
    moved = {m: F.round(F.col(m) + (F.col("_copy") % 7) / 10, 1) if m in ("tmk", "txk", "tnk", "tgk")
             else F.round(m, 1) for m in MEASURES}
    many = (
        obs.crossJoin(F.broadcast(spark.range(copies).withColumnRenamed("id", "_copy")))
        .withColumns(moved).withColumn("station", (F.col("_copy") * 100 + F.col("station")).cast("int"))
        .drop("_copy")
    )
    store.write_table(many, TABLE, buckets=16)
    return spark.table(TABLE).count()


def main() -> None:
    spark = local_session(CPUS, CPUS)
    obs = derived.observations(spark, SF_DIR)
    small = {**daily_queries(obs), **other_queries(spark, SF_DIR)}
    queries = {name: timed(q, REPEATS) for name, q in small.items()}
    scaled, rows = {}, 0
    if STATION_DAYS:
        rows = scaled_store(spark, obs.cache())
        big = spark.table(TABLE)
        # what the versioned store keeps beside the days
        months = stored(rollup.monthly_summary(C.clean(big)), "bench-months")
        state = stored(D.best_state(C.clean(big), dt.date(1999, 12, 31)), "bench-best")
        kept = {"rollup_yearly_mean": lambda: rollup.yearly_means(months), "rollup_extremes": lambda: rollup.extremes(months),
                "new_records_state": lambda: D.new_records_from_state(state, C.clean(big))}
        for name, query in {**daily_queries(big), **kept}.items():
            # the two with published numbers are measured warm, like those
            scaled[name] = timed(query, 3 if name in ("yearly_mean", "extremes", "rollup_yearly_mean", "rollup_extremes") else 1)
            print(name, scaled[name], file=sys.stderr)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": queries, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": CPUS,
        "scaled": scaled, "scaled_station_days": rows, "scaled_value": round(sum(scaled.values()), 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
