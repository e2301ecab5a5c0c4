"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # exact percentiles keep one buffer per group: allow more groups before the sort fallback
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def local_session(cores: int = 8, partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("isotherm")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ISOTHERM_DRIVER_MEMORY", "12g"))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one the cluster names in spark.checkpoint.dir.

    Where none is named (tests, single machine) it lies beside the tables, in the warehouse folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: ends the lineage and survives lost executors, unlike a local one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/isotherm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
