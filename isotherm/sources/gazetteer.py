"""Places and cities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.functions.sky import GRID_COLUMNS, GRID_ROWS, with_grid

# ---- fixed values --------------------------------------------------------------
STATES = {
    "01": "Baden-Württemberg", "02": "Bayern", "03": "Bremen", "04": "Hamburg", "05": "Hessen",
    "06": "Niedersachsen", "07": "Nordrhein-Westfalen", "08": "Rheinland-Pfalz", "09": "Saarland",
    "10": "Schleswig-Holstein", "11": "Brandenburg", "12": "Mecklenburg-Vorpommern",
    "13": "Sachsen", "14": "Sachsen-Anhalt", "15": "Thüringen", "16": "Berlin",
}
DEAD_PLACES = ["PPLH", "PPLQ", "PPLW", "PPLCH"]
SUMMITS = ["PK", "MT"]
# positions in the tab-separated file
NAME, LAT, LON, CLASS, CODE, STATE, POPULATION, HEIGHT, MODEL_HEIGHT = 1, 4, 5, 6, 7, 10, 14, 15, 16
COLUMNS = 19
# --------------------------------------------------------------------------------


def parse_places(rows: DataFrame) -> DataFrame:
    """Rows with columns _c0, _c1, ... -> name, lat/lon in thousandths, hoehe, land, einwohner."""
    def field(i):
        return F.coalesce(F.col(f"_c{i}"), F.lit(""))

    place = (field(CLASS) == "P") & ~field(CODE).isin(DEAD_PLACES)
    summit = (field(CLASS) == "T") & field(CODE).isin(SUMMITS)
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    height = F.when(field(HEIGHT) != "", field(HEIGHT).try_cast("int")).otherwise(
        field(MODEL_HEIGHT).try_cast("int"))
    return (
        rows.where((place | summit) & field(STATE).isin(list(STATES)))
        .select(
            field(0).alias("id"), field(NAME).alias("name"),
            F.bround(field(LAT).cast("double") * 1000, 0).cast("int").alias("lat_m"),
            F.bround(field(LON).cast("double") * 1000, 0).cast("int").alias("lon_m"),
            # the same in degrees, as the search around points takes them
            (F.bround(field(LAT).cast("double") * 1000, 0) / 1000).alias("lat"),
            (F.bround(field(LON).cast("double") * 1000, 0) / 1000).alias("lon"),
            F.when(height >= -100, height).alias("hoehe"),
            F.try_element_at(state, field(STATE)).alias("land"),
            F.coalesce(field(POPULATION).try_cast("bigint"), F.lit(0)).alias("einwohner"),
            summit.alias("gipfel"))
    )


def in_reading_order(places: DataFrame) -> DataFrame:
    """Larger places first, higher summits first, then by name."""
    return places.orderBy(F.desc("einwohner"), F.when(
        F.col("gipfel"), -F.coalesce("hoehe", F.lit(0))).otherwise(0), "name")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"_c{i} string" for i in range(COLUMNS))
    return parse_places(spark.read.schema(schema).csv(path, sep="\t", quote="", escape=""))


FEATURE = ("struct<properties: struct<NAME: string, NAME_DE: string, ADM0_A3: string, "
           "POP_MAX: double, ADM0CAP: int, LONGITUDE: double, LATITUDE: double>>")


def city_layer(features: DataFrame) -> DataFrame:
    """Point features (column feature: struct with properties) -> name, grid position, rank."""
    p = "feature.properties."
    people = F.coalesce(F.col(p + "POP_MAX"), F.lit(0.0))
    capital = F.coalesce(F.col(p + "ADM0CAP"), F.lit(0)) != 0
    home = F.coalesce(F.col(p + "ADM0_A3") == "DEU", F.lit(False))
    kept = features.where((home & (people >= 100_000)) | capital | (people >= 500_000)).select(
        F.coalesce(F.when(F.col(p + "NAME_DE") != "", F.col(p + "NAME_DE")), F.col(p + "NAME"))
        .alias("name"),
        F.col(p + "LONGITUDE").alias("lon"), F.col(p + "LATITUDE").alias("lat"),
        F.when((people >= 1_000_000) | capital, 1).when(people >= 300_000, 2).otherwise(3)
        .alias("rang"))
    placed = with_grid(kept).where(
        F.col("gx").between(0, GRID_COLUMNS) & F.col("gy").between(0, GRID_ROWS))
    return placed.select("name", "gx", "gy", "rang").orderBy("rang", "name")


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    collection = spark.read.schema(f"features array<{FEATURE}>").json(path, multiLine=True)
    return city_layer(collection.select(F.explode("features").alias("feature")))
