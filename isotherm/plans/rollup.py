"""A versioned store: days, and a monthly summary that is kept up to date beside them.

Layout below ``path``: ``tage/version=v/quelle=q/fach=f`` and ``monate/version=v/fach=f``, where
``fach`` is the station's bucket, and ``stand``, a journal of small files. A write puts its rows into
folders of a new version; only then one entry file in the journal names, for every bucket
written, the version that counts from now on, days and summary together. Readers go by
the newest entries, so they see the store before or after a write, never half of it, whenever a
writer dies. One writer at a time, as with the other stores.

A refresh rewrites the recent days of the touched buckets, and of their summary computes only
the months in which a recent day came, went or changed; the other months are copied.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.functions.calendar import mid_month, month_length
from isotherm.operators.clean import clean
from isotherm.operators.common import with_first_dates
from isotherm.operators.ingest import behind_history, with_bucket
from isotherm.schema import COVERAGE, FULL_YEAR, MEASURES, OBSERVATION

BUCKETS = 64
# extremes of a month whose first date is kept: date column -> (measure, column of the summary)
DATED = {f"{side}_{m}_am": (m, f"{side}_{m}") for m in ("tmk", "txk", "tnk") for side in ("max", "min")}
JOURNAL = "nr bigint, was string, quelle int, fach int, version string"


def monthly_summary(c: DataFrame, month: Column | None = None) -> DataFrame:
    """Per station and month: days, and for each measure count, sum, extremes; first dates for temperatures."""
    month = F.trunc("datum", "month") if month is None else month
    best = c.groupBy("station", month.alias("monat")).agg(F.count(F.lit(1)).alias("tage"), *[
        f(m).alias(f"{name}_{m}") for m in MEASURES
        for name, f in (("n", F.count), ("sum", F.sum), ("min", F.min), ("max", F.max))])
    return with_first_dates(best, c, {"station": F.col("station"), "monat": month}, DATED)


# ---- journal -------------------------------------------------------------------
def _entries(spark: SparkSession, path: str) -> list:
    """The newest entry of every part; as many rows as the store has buckets."""
    journal = spark.read.schema(JOURNAL).json(f"{path}/stand")
    newest = F.max_by("version", "nr").alias("version")
    return journal.groupBy("was", "quelle", "fach").agg(newest, F.max("nr").alias("nr")).collect()


def _commit(spark: SparkSession, path: str, nr: int, parts: list[tuple], was_versions: dict[str, str]) -> None:
    """One entry file; parts: (was, quelle, fach, whether it has rows). An entry without version says that a part is empty."""
    rows = [(nr, was, quelle, fach, was_versions[was] if filled else "-") for was, quelle, fach, filled in parts]
    spark.createDataFrame(rows, JOURNAL).coalesce(1).write.mode("append").json(f"{path}/stand")


def _read(spark: SparkSession, path: str, was: str, keep=lambda e: True, entries: list | None = None) -> DataFrame | None:
    entries = _entries(spark, path) if entries is None else entries
    folders = [f"{path}/{was}/version={e.version}" + (f"/quelle={e.quelle}" if was == "tage" else "") + f"/fach={e.fach}"
               for e in entries if e.was == was and e.version != "-" and keep(e)]
    if not folders:
        return None
    return spark.read.option("basePath", f"{path}/{was}").option("mergeSchema", "false").parquet(*folders).drop("version")


def _write_days(days: DataFrame, path: str, version: str) -> None:
    names = [f.name for f in OBSERVATION.fields]
    (days.select(*names, "fach").repartition("quelle", "fach", F.year("datum"))
     .sortWithinPartitions("quelle", "fach", "station", "datum")
     .write.partitionBy("quelle", "fach").parquet(f"{path}/tage/version={version}"))


def _write_months(months: DataFrame, path: str, version: str) -> None:
    months.repartition("fach").sortWithinPartitions("station", "monat").write.partitionBy("fach").parquet(f"{path}/monate/version={version}")


def _filled(spark: SparkSession, path: str, was: str, version: str) -> set:
    """(quelle, fach) that a new version has rows of; the folders' names say it."""
    columns = ["quelle", "fach"] if was == "tage" else ["fach"]
    rows = spark.read.parquet(f"{path}/{was}/version={version}").select(*columns).distinct().collect()
    return {(r["quelle"] if was == "tage" else None, r["fach"]) for r in rows}


# ---- writing -------------------------------------------------------------------
def build_rollup_store(spark: SparkSession, obs: DataFrame, path: str, buckets: int = BUCKETS, level: str = "alle") -> None:
    """A new store of historical (quelle 0) and recent (quelle 1) days; level is the quality level of the summary."""
    version = f"v{uuid.uuid4().hex}"
    _write_days(with_bucket(obs, buckets), path, version)
    days = spark.read.option("basePath", f"{path}/tage").parquet(f"{path}/tage/version={version}").drop("version")
    _write_months(with_bucket(monthly_summary(clean(_resolved(days), level)), buckets), path, version)
    parts = [(was, q, f, True) for was in ("tage", "monate") for q, f in _filled(spark, path, was, version)]
    _commit(spark, path, 0, parts, {"tage": version, "monate": version})


def _resolved(days: DataFrame) -> DataFrame:
    hist = days.where("quelle = 0")
    ends = hist.groupBy("station").agg(F.max("datum").alias("_ende"))
    return hist.unionByName(behind_history(days.where("quelle = 1"), ends))


def refresh_rollup_store(spark: SparkSession, new_recent: DataFrame, path: str, buckets: int = BUCKETS, level: str = "alle") -> None:
    """Replace the recent days of the stations that come new, and the months they touch."""
    entries = _entries(spark, path)
    fresh = with_bucket(new_recent.withColumn("quelle", F.lit(1)), buckets).persist()
    try:
        stations = fresh.select("station", "fach").distinct()
        # at most ``buckets`` numbers
        touched = {r.fach for r in stations.select("fach").distinct().collect()}
        if not touched:
            return
        names = [*[f.name for f in OBSERVATION.fields], "fach"]
        old = _read(spark, path, "tage", lambda e: e.fach in touched and e.quelle == 1, entries)
        old = fresh.select(*names).limit(0) if old is None else old.select(*names)
        version = f"v{uuid.uuid4().hex}"
        kept = old.join(stations.select("station"), "station", "left_anti").select(*names)
        _write_days(kept.unionByName(fresh.select(*names)), path, version)

        was = old.join(stations.select("station"), "station", "left_semi")
        month = F.trunc("datum", "month").alias("monat")
        months = was.select("station", month).unionByName(fresh.select("station", month)).distinct().persist()
        # the first touched month: the scan of the history begins there
        since = months.agg(F.min("monat")).first()[0]
        hist = _read(spark, path, "tage", lambda e: e.fach in touched and e.quelle == 0, entries)
        both = fresh.select(*names)
        if hist is not None:
            hist = hist.select(*names)
            ends = hist.join(stations.select("station"), "station", "left_semi").groupBy("station").agg(F.max("datum").alias("_ende"))
            both = hist.where(F.col("datum") >= F.lit(since)).unionByName(behind_history(both, ends).select(*names))
        days = both.withColumn("monat", F.trunc("datum", "month")).join(months, ["station", "monat"], "left_semi").drop("monat")
        made = with_bucket(monthly_summary(clean(days, level)), buckets)
        before = _read(spark, path, "monate", lambda e: e.fach in touched, entries)
        if before is not None:
            made = made.unionByName(before.join(months, ["station", "monat"], "left_anti").select(*made.columns))
        _write_months(made, path, version)
        filled = {w: _filled(spark, path, w, version) for w in ("tage", "monate")}
        parts = [("tage", 1, f, (1, f) in filled["tage"]) for f in sorted(touched)] + [("monate", None, f, (None, f) in filled["monate"]) for f in sorted(touched)]
        _commit(spark, path, 1 + max(e.nr for e in entries), parts, {"tage": version, "monate": version})
        months.unpersist()
    finally:
        fresh.unpersist()


# ---- reading -------------------------------------------------------------------
def read_days(spark: SparkSession, path: str) -> DataFrame:
    """Historical days and the recent days behind them, as of the newest write."""
    return _resolved(_read(spark, path, "tage")).select(*[f.name for f in OBSERVATION.fields])


def read_months(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "monate").drop("fach")


def yearly_means(months: DataFrame, column: str = "tmk", min_days: int = FULL_YEAR) -> DataFrame:
    """Means of full years (Q7) from the monthly summary."""
    n = F.sum(f"n_{column}")
    return (
        months.groupBy("station", F.year("monat").alias("jahr"))
        .agg((F.sum(f"sum_{column}") / n).alias("m"), n.alias("tage")).where(F.col("tage") >= min_days)
    )


def monthly_series(months: DataFrame, column: str = "tmk", share: float = COVERAGE) -> DataFrame:
    """Means of well covered months (Q6)."""
    return (
        months.where((F.col(f"n_{column}") > 0) & (F.col(f"n_{column}") >= month_length(F.col("monat")) * share))
        .select("station", "monat", (F.col(f"sum_{column}") / F.col(f"n_{column}")).alias("wert"),
                F.col(f"n_{column}").alias("tage"), mid_month(F.col("monat")).alias("t"))
    )


def extremes(months: DataFrame) -> DataFrame:
    """Hottest maximum and coldest minimum with their first dates (A3)."""
    best = months.groupBy("station").agg(F.max("max_txk").alias("heiss"), F.min("min_tnk").alias("kalt"))
    hits = months.join(best, "station").groupBy("station").agg(
        F.min(F.when(F.col("max_txk") == F.col("heiss"), F.col("max_txk_am"))).alias("heiss_datum"),
        F.min(F.when(F.col("min_tnk") == F.col("kalt"), F.col("min_tnk_am"))).alias("kalt_datum"))
    return best.join(hits, "station").select("station", "heiss", "heiss_datum", "kalt", "kalt_datum")


def coverage(months: DataFrame) -> DataFrame:
    """Days per station from the summary."""
    return months.groupBy("station").agg(F.sum("tage").alias("tage"))
