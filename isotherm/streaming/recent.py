"""Continuous ingest: arriving recent files replace the recent part of their stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isotherm.plans.store import BUCKETS, refresh_recent
from isotherm.session import stored
from isotherm.sources.daily import failed_files, observations_of, parse_files

ARRIVING = "path string, modificationTime timestamp, length bigint, content binary"


def newest_per_station(rows: DataFrame, arrived: DataFrame) -> DataFrame:
    """Where several files of a station arrive together, the newest file counts."""
    files = rows.select("station", "path").distinct().join(arrived, "path")
    newest = files.groupBy("station").agg(F.max(F.struct("zeit", "path")).alias("_n"))
    return rows.join(newest.select("station", F.col("_n.path").alias("path")), ["station", "path"], "left_semi").drop("path")


def stream_recent(spark: SparkSession, in_dir: str, table: str, checkpoint: str, failed_dir: str,
                  buckets: int = BUCKETS) -> StreamingQuery:
    """Take what lies in ``in_dir`` and stop; the same file twice leaves the same store.

    A batch parses its files once, into a table in the shared folder that everything else reads.
    Files that could not be read are written below ``failed_dir`` (path, fehler, zeit), one folder
    per batch: a batch that runs again writes the same folder again.
    """
    files = spark.readStream.format("binaryFile").schema(ARRIVING).load(in_dir).select(
        "path", F.col("modificationTime").alias("zeit"), "content")

    def load(batch: DataFrame, number: int) -> None:
        rows = stored(parse_files(batch, 1), "arrived")
        # names and times only: the contents are not read for this
        arrived = batch.select("path", "zeit")
        failed_files(rows).join(arrived, "path").write.mode("overwrite").parquet(f"{failed_dir}/charge={number}")
        refresh_recent(batch.sparkSession, newest_per_station(observations_of(rows), arrived), table, buckets)

    return (
        files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def failed_arrivals(spark: SparkSession, failed_dir: str) -> DataFrame:
    """Files of all batches that could not be read: path, fehler, zeit, charge."""
    return spark.read.schema("path string, fehler string, zeit timestamp, charge int").parquet(failed_dir)
