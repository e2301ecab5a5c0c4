"""Stations and places near a point.

Nearest-neighbour search without pairing every point with every station. The globe is cut into
nested cells of latitude and longitude (1/1024 degree and doublings), and of height where height
costs. Equi-joins on cells:

1. Per occupied point cell the smallest block of 3 x 3 (x 3) cells that holds enough stations; the
   true costs of the stations in it bound a point's n-th best cost from above.
2. The cells that reach within that bound of the point, at a level where they are its neighbours;
   what lies beyond cannot cost less.

Cells are as fine as the stations are dense, so a point meets a few stations however many there
are. Of stations at one spot (and height) only the first n can be among the best n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.calendar import new_year
from isotherm.functions.sky import distance_km, with_grid

CELL = 1 / 1024                  # degrees, about 100 m
LEVELS = 18                      # 1/1024, 1/512, ... 128 degrees
KM_PER_DEGREE = 111.0            # a little less than a degree of latitude measures
# names within these many thousandths of a degree are candidates for a point
NAME_BOX = (150, 250)
BOX_LEVELS = 10                  # cells up to half a degree: blocks larger than the box are of no use
SUMMIT_KM, NEAR_KM = 0.5, 2.0
KEYS = ["lage", "stufe", "zx", "zy", "zz"]


def _size(level: Column) -> Column:
    return F.lit(CELL) * F.pow(F.lit(2.0), level)


def _row(lat: Column, level: Column) -> Column:
    return F.floor((lat + 90) / _size(level))


def _column(lon: Column, level: Column) -> Column:
    """Columns of cells go round the globe; the last one may be narrower."""
    return F.floor(F.pmod(lon + 180, F.lit(360.0)) / _size(level))


def _columns(level: Column) -> Column:
    return F.ceil(360.0 / _size(level))


def with_distance(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str) -> DataFrame:
    return df.withColumn("km", distance_km(*[F.col(c) for c in (lat1, lon1, lat2, lon2)]))


def pair_distances(pairs: DataFrame, points: DataFrame, st: DataFrame) -> DataFrame:
    """Great-circle distance of given (punkt, station) pairs."""
    p = points.select(F.col("id").alias("punkt"), F.col("lat").alias("_a"), F.col("lon").alias("_b"))
    s = st.select(F.col("id").alias("station"), F.col("lat").alias("_c"), F.col("lon").alias("_d"))
    joined = pairs.join(p, "punkt").join(s, "station")
    return with_distance(joined, "_a", "_b", "_c", "_d").drop("_a", "_b", "_c", "_d")


def _levels_down(df: DataFrame, levels: int) -> DataFrame:
    """Rows (lage, lat, lon, z) once per level with their cell; z is height as degrees of equal cost."""
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("stufe"))
    s = F.col("stufe")
    return rows.withColumns({"zx": _column(F.col("lon"), s), "zy": _row(F.col("lat"), s), "zz": F.floor(F.col("z") / _size(s))})


def _ring(rows: DataFrame, up: Column, side: Column) -> DataFrame:
    """Every row once per cell at most ``up`` rows (and heights) and ``side`` columns away, each cell once."""
    n = _columns(F.col("stufe"))
    all_round = 2 * side + 1 >= n
    columns = F.when(all_round, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.transform(
        F.sequence(-side, side), lambda a: F.pmod(F.col("_x") + a, n)))
    lines = F.sequence(F.greatest(F.col("_y") - up, F.lit(0).cast("bigint")), F.col("_y") + up)
    # height counts in the first group only
    heights = F.when(F.col("lage") == 0, F.sequence(F.col("_z") - up, F.col("_z") + up)).otherwise(F.array("_z"))
    return rows.select("*", F.explode(columns).alias("zx")).select("*", F.explode(lines).alias("zy")).select(
        "*", F.explode(heights).alias("zz")).drop("_x", "_y", "_z")


def _first_level(points: DataFrame, sites: DataFrame, n: int, levels: int) -> DataFrame:
    """Per finest point cell (lage, fx, fy, fz) the level of the smallest block with ``n`` sites, if there is one."""
    one, s = F.lit(1).cast("bigint"), F.col("stufe")
    counts = _levels_down(sites.select("lage", "lat", "lon", "z"), levels).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    around = _ring(counts.withColumnsRenamed({"zx": "_x", "zy": "_y", "zz": "_z"}), one, one)
    blocks = around.groupBy(*KEYS).agg(F.sum("n").alias("n")).where(F.col("n") >= n).select(*KEYS)
    # levels are nested: a coarser cell's number is the finer one's without its last bits
    cells = points.select("lage", "fx", "fy", "fz").distinct().select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("stufe")).withColumns(
        {c: F.floor(F.col(f) / F.pow(F.lit(2.0), s)) for c, f in (("zx", "fx"), ("zy", "fy"), ("zz", "fz"))})
    return cells.join(blocks.hint("merge"), KEYS).groupBy("lage", "fx", "fy", "fz").agg(F.min("stufe").alias("stufe"))


def _costs(wanted: DataFrame, targets: DataFrame, climb: float, inside: Column | None) -> DataFrame:
    """Points beside the sites of their cells with km and wert."""
    # both sides grow with their tables, whatever their files' sizes say: neither is sent round
    near = with_distance(wanted.join(targets.hint("merge"), KEYS), "p_lat", "p_lon", "lat", "lon")
    if inside is not None:
        near = near.where(inside)
    up = F.coalesce(F.abs(F.col("hoehe") - F.col("p_hoehe")), F.lit(0)) * climb
    return near.withColumn("wert", F.col("km") + up)


def _search(at: DataFrame, sites: DataFrame, n: int, climb: float, per: list[str], inside: Column | None = None,
            box: tuple[float, float] | None = None) -> DataFrame:
    """All sites that can be among the best ``n`` of a point: cost is km plus ``climb`` per metre of height.

    at: punkt, p_lat, p_lon, p_hoehe, lage, most (km to look at most). sites: station, lat, lon, hoehe, lage and others.
    Points meet the sites of their own group (lage); height makes cells in group 0 only.
    box: degrees to either side that contain all that is ``inside``.
    """
    def steep(h):
        return F.when(F.col("lage") == 0, F.col(h) * (climb / KM_PER_DEGREE)).otherwise(0.0) if climb else F.lit(0.0)

    levels = BOX_LEVELS if box else LEVELS
    zero, one, s = F.lit(0), F.lit(1).cast("bigint"), F.col("stufe")
    spot = Window.partitionBy("lage", "lat", "lon", "hoehe").orderBy("station", *[c for c in ("name",) if c in sites.columns])
    first_ones = sites.withColumn("_nr", F.row_number().over(spot)).where(F.col("_nr") <= n).drop("_nr").withColumn("z", steep("hoehe"))
    targets = _levels_down(first_ones, levels).drop("z")
    at = at.withColumn("p_z", steep("p_hoehe"))
    at = at.withColumns({"fx": _column(F.col("p_lon"), zero), "fy": _row(F.col("p_lat"), zero), "fz": F.floor(F.col("p_z") / CELL)})
    here = {"_x": _column(F.col("p_lon"), s), "_y": _row(F.col("p_lat"), s), "_z": F.floor(F.col("p_z") / _size(s))}
    found = _first_level(at, first_ones, n, levels).hint("merge")
    cell = ["lage", "fx", "fy", "fz"]
    # fewer sites than asked for: the widest level holds all there are
    first = at.join(found, cell) if box else at.join(found, cell, "left").withColumn("stufe", F.coalesce("stufe", F.lit(levels - 1)))
    seen = _costs(_ring(first.drop("fx", "fy", "fz").withColumns(here), one, one), targets, climb, inside)
    if n == 1:
        limit = seen.groupBy(*per).agg(F.min("wert").alias("_w"))
    else:
        limit = seen.groupBy(*per).agg(F.slice(F.sort_array(F.collect_list("wert")), 1, n).alias("_w")).withColumn(
            # fewer than n seen: all count
            "_w", F.when(F.size("_w") >= n, F.element_at("_w", -1)))
    limit = limit.select(*[F.col(c).alias(f"_{c}") for c in per], (F.col("_w") + 1e-6).alias("_w"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in per]
    bounded = at.drop("fx", "fy", "fz").join(limit.hint("merge"), same, "left").drop(*[f"_{c}" for c in per]).withColumn(
        "most", F.least("most", F.coalesce("_w", F.lit(1e9)))).drop("_w")
    # a degree of longitude is shortest at the end of the circle that lies nearer to the pole
    tall = F.least(F.col("most") / KM_PER_DEGREE, F.lit(180.0))
    edge = F.abs("p_lat") + tall
    # half the angle, exactly: sin(dlon / 2) = sin(d / 2) / cos(lat) at most; beyond a pole all round
    wide = F.when(edge >= 89.9, 360.0).otherwise(F.degrees(
        2 * F.asin(F.least(F.lit(1.0), F.sin(F.radians(tall / 2)) / F.cos(F.radians(edge))))))
    if box:
        tall, wide = F.least(tall, F.lit(box[0])), F.least(wide, F.lit(box[1]))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(tall, F.least(wide, F.lit(90.0))) / CELL))).cast("int")
    second = bounded.withColumns({"_tall": tall, "_wide": wide, "stufe": F.least(level, F.lit(levels - 1))}).withColumns(here)
    second = _ring(second, F.ceil(F.col("_tall") / _size(s)), F.ceil(F.col("_wide") / _size(s)))
    return _costs(second.drop("_tall", "_wide"), targets, climb, inside).where(F.col("wert") <= F.col("most"))


def _candidates(points: DataFrame, st: DataFrame, n: int, climb: float) -> DataFrame:
    """All stations that can be among the best ``n`` of a point.

    Where height costs there are three groups: heights against heights (0), points without height against
    all stations (1), points with one against stations without (2).
    """
    placed = st.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col("id").alias("station"), "hoehe", "lat", "lon")
    at = points.where(F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.col("id").alias("punkt"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col("hoehe").alias("p_hoehe"),
        F.lit(1e9).alias("most"))

    def groups(height, known, missing):
        return F.explode(F.when(F.col(height).isNotNull(), F.array(*map(F.lit, known))).otherwise(F.array(*map(F.lit, missing)))).alias("lage")

    if climb:
        at, placed = at.select("*", groups("p_hoehe", (0, 2), (1,))), placed.select("*", groups("hoehe", (0, 1), (1, 2)))
    else:
        at, placed = at.withColumn("lage", F.lit(1)), placed.withColumn("lage", F.lit(1))
    return _search(at, placed, n, climb, ["punkt"])


def _active(st: DataFrame, year: int) -> DataFrame:
    """Data up to at least the year before."""
    return st.where(F.col("bis") >= new_year(F.lit(year - 1)))


def nearest_station(points: DataFrame, st: DataFrame, active: bool = True,
                    year: int | None = None) -> DataFrame:
    """points: id, lat, lon (hoehe optional). The nearest station, the lower id among equals."""
    if active:
        st = _active(st, year)
    if "hoehe" not in points.columns:
        points = points.withColumn("hoehe", F.lit(None).cast("int"))
    best = F.min(F.struct("km", "station")).alias("b")
    return _candidates(points, st, 1, 0.0).groupBy("punkt").agg(best).select(
        "punkt", "b.station", "b.km")


def suitable_stations(points: DataFrame, st: DataFrame, n: int = 3, year: int | None = None,
                      min_years: int = 30) -> DataFrame:
    """The best ``n`` active stations of at least thirty years; 100 m of height cost as 10 km."""
    long_enough = F.year("bis") - F.year("von") + 1 >= min_years
    found = _candidates(points, _active(st, year).where(long_enough), n, 0.1)
    w = Window.partitionBy("punkt").orderBy("wert", "station")
    return (
        found.withColumn("dh", F.col("hoehe") - F.col("p_hoehe"))
        .withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= n)
        .select("punkt", "nr", "station", "km", "dh", "wert")
    )


def place_name(points: DataFrame, places: DataFrame) -> DataFrame:
    """A summit within 500 m, else the nearest place, with "bei" from 2 km on."""
    box_lat, box_lon = NAME_BOX

    def mille(c):
        return F.floor(F.col(c) * 1000 + 0.5)

    inside = (F.abs(mille("lat") - mille("p_lat")) <= box_lat) & (F.abs(mille("lon") - mille("p_lon")) <= box_lon)
    none = F.lit(None).cast("int")
    summits = F.col("gipfel").cast("int") + 1          # groups of their own: places 1, summits 2
    known = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("gipfel").isNotNull()).select(
        F.col("id").alias("station"), "name", "gipfel", "lat", "lon", none.alias("hoehe"), summits.alias("lage"))
    asked = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.col("id").alias("punkt"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), none.alias("p_hoehe"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("lage")).withColumn("most", F.when(F.col("lage") == 2, SUMMIT_KM).otherwise(1e9))
    # a rounded difference of n thousandths is less than n + 1 of them
    reach = ((box_lat + 1.5) / 1000, (box_lon + 1.5) / 1000)
    near = _search(asked, known, 1, 0.0, ["punkt", "lage"], inside, reach).withColumnRenamed("station", "ort")
    hit = F.struct("km", "ort", "name")
    best = near.groupBy("punkt").agg(
        F.min(F.when(F.col("gipfel") & (F.col("km") < SUMMIT_KM), hit)).alias("g"),
        F.min(F.when(~F.col("gipfel"), hit)).alias("o"))
    summit = F.col("g").isNotNull()
    label = F.when(F.col("o.km") > NEAR_KM, F.concat(F.lit("bei "), F.col("o.name"))).otherwise(
        F.col("o.name"))
    return best.where(summit | F.col("o").isNotNull()).select(
        "punkt", F.when(summit, F.col("g.ort")).otherwise(F.col("o.ort")).alias("ort"),
        F.when(summit, F.col("g.km")).otherwise(F.col("o.km")).alias("km"),
        F.when(summit, F.col("g.name")).otherwise(label).alias("name"))


def station_points(st: DataFrame, year: int) -> DataFrame:
    """Active stations with their position in the radar grid."""
    return with_grid(_active(st, year).where(F.col("lat").isNotNull())).select(
        "id", "name", "gx", "gy")
