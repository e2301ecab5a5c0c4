"""The observation store: building, reading, refreshing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.operators.ingest import (
    behind_history, merge_sources, with_bucket, write_observations,
)
from isotherm.session import new_folder
from isotherm.sources.daily import read_archives
from isotherm.sources.listings import archive_manifest, read_stations

BUCKETS = 64


def write_store(obs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    write_observations(obs, path, buckets)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Historical days and the recent days behind them.

    The recent folders hold the recent files as they came; the overlap is resolved here, so a
    new historical delivery takes effect without rewriting anything else.
    """
    stored = spark.read.parquet(path)
    ends = stored.where("quelle = 0").groupBy("station").agg(F.max("datum").alias("_ende"))
    return stored.where("quelle = 0").unionByName(
        behind_history(stored.where("quelle = 1"), ends)).drop("fach")


def refresh_recent(spark: SparkSession, new_recent: DataFrame, path: str,
                   buckets: int = BUCKETS) -> None:
    """Replace the recent part of the stations that come new; only their buckets are rewritten."""
    fresh = with_bucket(new_recent.withColumn("quelle", F.lit(1)), buckets).persist()
    try:
        # at most ``buckets`` numbers: they prune the folders that are read again
        touched = [r.fach for r in fresh.select("fach").distinct().collect()]
        if not touched:
            return
        stored = spark.read.parquet(path).where(
            (F.col("quelle") == 1) & F.col("fach").isin(touched))
        kept = stored.join(fresh.select("station").distinct(), "station", "left_anti")
        both = kept.unionByName(fresh.select(*kept.columns))
        write_observations(both, path, buckets, only_touched=True)
    finally:
        fresh.unpersist()


def build_dataset(spark: SparkSession, station_list: str, listing: DataFrame, hist_archives: str,
                  recent_archives: str, out: str, ids: DataFrame | None = None
                  ) -> dict[str, DataFrame]:
    """Station list, manifest and the chosen series written as one store.

    Returns stations, manifest and the archives that failed.
    """
    stations = read_stations(spark, station_list)
    manifest = archive_manifest(listing)
    hist, failed_hist = read_archives(spark, hist_archives)
    recent, failed_recent = read_archives(spark, recent_archives)
    obs = merge_sources(hist.drop("path"), recent.drop("path"))
    if ids is not None:
        obs = obs.join(ids.select("station").distinct(), "station", "left_semi")
    write_store(obs, f"{out}/observations")
    stations.write.mode("overwrite").json(f"{out}/stations")
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    return {"stations": stations, "manifest": manifest,
            "failed": failed_hist.unionByName(failed_recent)}


def _resolved(obs: DataFrame) -> DataFrame:
    hist = obs.where("quelle = 0")
    return hist.unionByName(behind_history(obs.where("quelle = 1"), hist.groupBy("station").agg(F.max("datum").alias("_ende"))))


def write_table(obs: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """The store as one table, bucketed by station and sorted by day; the overlap is resolved here.

    Spark knows how a bucketed table is distributed: aggregates, windows and joins by station need
    no shuffle of the days. ``buckets`` follows the data: some hundred MB each. Provenance is a
    partition of the table, so that a refresh rewrites the recent days only.
    """
    (
        _resolved(obs).repartition(buckets, "station")
        .write.mode("overwrite").partitionBy("quelle").bucketBy(buckets, "station")
        .sortBy("station", "datum").saveAsTable(name)
    )


def refresh_table(spark: SparkSession, new_recent: DataFrame, name: str) -> None:
    """Replace the recent part of the stations that come new; history is read but not written."""
    fresh = new_recent.withColumn("quelle", F.lit(1))
    stored = spark.table(name)
    kept = stored.where("quelle = 1").join(fresh.select("station").distinct(), "station", "left_anti")
    both = _resolved(stored.where("quelle = 0").unionByName(kept).unionByName(fresh.select(*stored.columns)))
    # written aside first: a table is not overwritten from itself
    aside = new_folder(spark, "recent")
    both.where("quelle = 1").write.parquet(aside)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        spark.read.schema(stored.schema).parquet(aside).select(*stored.columns).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
