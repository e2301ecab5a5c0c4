"""From loaded files to the store: merge, refresh, load state, retention, sinks."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REFRESH_AFTER_SECONDS = 3 * 3600


def behind_history(recent: DataFrame, ends: DataFrame) -> DataFrame:
    """Recent days strictly after the station's last historical day."""
    return (
        recent.join(ends, "station", "left")
        .where(F.col("_ende").isNull() | (F.col("datum") > F.col("_ende"))).drop("_ende")
    )


def _ends(hist: DataFrame) -> DataFrame:
    return hist.groupBy("station").agg(F.max("datum").alias("_ende"))


def merge_sources(hist: DataFrame, recent: DataFrame) -> DataFrame:
    """Historical days win; recent days only continue them."""
    hist = hist.withColumn("quelle", F.lit(0))
    recent = recent.withColumn("quelle", F.lit(1))
    return hist.unionByName(behind_history(recent, _ends(hist)))


def replace_recent(obs: DataFrame, new_recent: DataFrame) -> DataFrame:
    """For the stations that come new: their recent part replaced, history untouched."""
    fresh = new_recent.select("station").distinct()
    old = obs.where((F.col("quelle") != 1) | F.col("quelle").isNull()).unionByName(
        obs.where(F.col("quelle") == 1).join(fresh, "station", "left_anti"))
    added = behind_history(new_recent.withColumn("quelle", F.lit(1)),
                           _ends(obs.where(F.col("quelle") == 0)))
    return old.unionByName(added)


def refresh_plan(manifest: DataFrame, load_state: DataFrame, now,
                 max_age_seconds: int = REFRESH_AFTER_SECONDS) -> DataFrame:
    """Per station ``voll``, ``recent`` or ``nichts``.

    manifest: station, datei. load_state: station, hist_datei, recent_am (unix seconds).
    """
    now = now if isinstance(now, Column) else F.lit(float(now))
    old = F.col("recent_am").isNull() | (now - F.col("recent_am") > max_age_seconds)
    other_file = F.col("datei").isNotNull() & ~F.col("hist_datei").eqNullSafe(F.col("datei"))
    return (
        manifest.withColumn("_m", F.lit(True))
        .join(load_state.withColumn("_s", F.lit(True)), "station", "full")
        .withColumn("aktion", F.when(F.col("_s").isNull(), "voll").when(other_file, "voll")
                    .when(old, "recent").otherwise("nichts"))
        .select("station", "datei", "hist_datei", "recent_am", "aktion")
    )


def update_load_state(state: DataFrame, loads: DataFrame) -> DataFrame:
    """Upsert; a NULL in the new load keeps what was known."""
    new = loads.select("station", F.col("hist_datei").alias("_d"), F.col("recent_am").alias("_r"))
    return state.join(new, "station", "full").select(
        "station", F.coalesce("_d", "hist_datei").alias("hist_datei"),
        F.coalesce("_r", "recent_am").alias("recent_am"))


def obsolete_archives(files: DataFrame, manifest: DataFrame, active: DataFrame) -> DataFrame:
    """Cached archives (column ``datei``) that no active station's manifest entry names."""
    kept = manifest.join(active.select("station"), "station", "left_semi").select("datei")
    return files.where(F.endswith("datei", F.lit(".zip"))).join(kept, "datei", "left_anti")


def freshest(snapshots: DataFrame, *keys: str) -> DataFrame:
    """Of several results the one with the greatest (stand, erstellt)."""
    newest = F.max_by(F.struct(*snapshots.columns), F.struct("stand", "erstellt")).alias("r")
    return snapshots.groupBy(*keys).agg(newest).select("r.*")


def expired(runs: DataFrame, now, keep: int = 5, days: int = 14, group: str = "gruppe",
            finished: str = "completed") -> DataFrame:
    """Finished rows beyond the newest ``keep`` of their group and older than ``days``.

    Numbers are only needed up to ``keep``: the newest are found with a row limit per group,
    which every task applies before the shuffle, and everything else is beyond them.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    done = runs.where(F.col("status") == finished)
    newest = (
        done.select(group, "id", "erstellt")
        .withColumn("_nr", F.row_number().over(
            Window.partitionBy(group).orderBy(F.desc("erstellt"), F.desc("id"))))
        .where(F.col("_nr") <= keep).select(group, "id")
    )
    old = done.where(F.col("erstellt") < now - F.make_dt_interval(F.lit(days)))
    return old.join(newest, [group, "id"], "left_anti")


def write_observations(obs: DataFrame, path: str, buckets: int = 64,
                       only_touched: bool = False) -> None:
    """Parquet clustered by station and day; folders by provenance and station bucket.

    ``only_touched`` replaces just the folders the given rows fall into.

    ``fach`` is the unit a refresh rewrites. Rows are spread by (fach, year), so that one
    heavy station is written by several tasks.
    """
    spread = [F.col("quelle"), F.col("fach"), F.year("datum")]
    (
        with_bucket(obs, buckets).repartition(*spread)
        .sortWithinPartitions("quelle", "fach", "station", "datum")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if only_touched else "static")
        .partitionBy("quelle", "fach").parquet(path)
    )


def with_bucket(obs: DataFrame, buckets: int = 64) -> DataFrame:
    return obs.withColumn("fach", F.pmod(F.xxhash64("station"), F.lit(buckets)).cast("int"))


def write_snapshot(snapshot: DataFrame, path: str, created: dt.datetime | Column) -> str:
    """The national snapshot as JSON documents, one per station and measure, plus its day.

    Every write makes a folder of its own and then, in one small commit, an entry in ``stand``
    that names it. Readers go by the newest entry, so they see the old result or the new one,
    whenever a writer fails; an overwrite would delete the old one first. The document is not put
    together in one task, so it may be of any size. Returns the folder.
    """
    spark = snapshot.sparkSession
    created = created if isinstance(created, Column) else F.lit(created)
    version = f"v-{uuid.uuid4().hex}"
    snapshot_documents(snapshot).withColumn("erstellt", created).write.json(f"{path}/{version}")
    entry = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("zeit"))
    entry.coalesce(1).write.mode("append").json(f"{path}/stand")
    return f"{path}/{version}"


def newest_snapshot(spark: SparkSession, path: str) -> str:
    """The folder of the newest complete snapshot."""
    entries = spark.read.schema("version string, zeit timestamp").json(f"{path}/stand")
    return f"{path}/{entries.agg(F.max_by('version', 'zeit')).first()[0]}"


def snapshot_documents(snapshot: DataFrame) -> DataFrame:
    """Per station: name, land, height and for each measure its values by day."""
    per_measure = snapshot.groupBy("station", "name", "land", "hoehe", "spalte").agg(
        F.max("datum").alias("stand"),
        # as many entries as the snapshot has days
        F.sort_array(F.collect_list(F.struct("datum", "wert"))).alias("_w"))
    return per_measure.select(
        "stand", "station", "name", "land", "hoehe", "spalte",
        F.transform("_w", lambda w: w["datum"]).alias("tage"),
        F.transform("_w", lambda w: w["wert"]).alias("werte"))
