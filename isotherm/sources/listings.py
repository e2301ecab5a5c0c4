"""Station list and directory listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values --------------------------------------------------------------
ENCODING = "ISO-8859-1"
STATION_LINE = r"^\s*(\d+)\s+(\d{8})\s+(\d{8})\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S.*)$"
HISTORICAL_LINK = r'href="(tageswerte_KL_(\d{5})_(\d{8})_(\d{8})_hist\.zip)"'
RECENT_LINK = r"tageswerte_KL_(\d{5})_akt\.zip"
# --------------------------------------------------------------------------------


def parse_stations(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of the station list; headings, dashes and malformed lines drop out.

    Names may hold single blanks: name, state and release are parted by two or more.
    """
    def part(i: int) -> Column:
        return F.regexp_extract(column, STATION_LINE, i)

    rest = F.filter(F.split(F.trim(part(7)), r"\s{2,}"), lambda p: p != "")
    return (
        lines.where(F.col(column).rlike(STATION_LINE))
        .select(part(1).try_cast("int").alias("id"), rest.alias("_r"),
                part(4).try_cast("double").alias("_h"), part(5).try_cast("double").alias("lat"),
                part(6).try_cast("double").alias("lon"), part(2).alias("_von"), part(3).alias("_bis"))
        .where(F.col("_h").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .select("id", F.coalesce(F.get("_r", F.lit(0)), F.lit("")).alias("name"),
                F.coalesce(F.get("_r", F.lit(1)), F.lit("")).alias("land"),
                F.col("_h").cast("int").alias("hoehe"), "lat", "lon",
                F.to_date(F.try_to_timestamp("_von", F.lit("yyyyMMdd"))).alias("von"),
                F.to_date(F.try_to_timestamp("_bis", F.lit("yyyyMMdd"))).alias("bis"))
    )


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """The list is Latin-1, which the text source does not read."""
    text = F.decode("content", ENCODING)
    lines = spark.read.format("binaryFile").load(path).select(
        F.explode(F.split(text, r"\r\n|\r|\n")).alias("value"))
    return parse_stations(lines)


def archive_manifest(pages: DataFrame, pattern: str = HISTORICAL_LINK, file_group: int = 1,
                     id_group: int = 2, numeric: bool = True) -> DataFrame:
    """Listing pages (seite, html) -> station and file name; a later link replaces an earlier."""
    files = F.regexp_extract_all("html", F.lit(pattern), F.lit(file_group))
    ids = F.regexp_extract_all("html", F.lit(pattern), F.lit(id_group))
    links = pages.select("seite", F.posexplode(F.arrays_zip(files.alias("datei"), ids.alias("id"))))
    sid = F.col("col.id").cast("int") if numeric else F.col("col.id")
    return links.groupBy(sid.alias("station")).agg(
        F.max_by("col.datei", F.struct("seite", "pos")).alias("datei"))


def active_stations(pages: DataFrame, pattern: str = RECENT_LINK, numeric: bool = True) -> DataFrame:
    """Stations with a link to recent days."""
    found = F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("station")
    out = pages.select(found).distinct()
    return out.withColumn("station", F.col("station").cast("int")) if numeric else out
