"""Sun elevation, rain classes, distances and the radar projection, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: radar grid and its polar stereographic projection ---------
GRID_COLUMNS, GRID_ROWS = 1100, 1200
AXIS_A, AXIS_B = 6378137.0, 6356752.3142451802
FALSE_X, FALSE_Y = 543196.83521776402, 3622588.8619310018
LATITUDE_OF_SCALE, CENTRAL_LONGITUDE = 60.0, 10.0
EARTH_RADIUS_KM = 6371.0
RAIN_CLASSES = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0]
SUN_ON_HORIZON = -0.833
# ------------------------------------------------------------------------------
ECCENTRICITY = math.sqrt(1 - (AXIS_B / AXIS_A) ** 2)


def _isometric_py(phi: float) -> float:
    es = ECCENTRICITY * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (ECCENTRICITY / 2)


_PHI_S = math.radians(LATITUDE_OF_SCALE)
# metres of radius per unit of the isometric colatitude
SCALE = (AXIS_A * math.cos(_PHI_S) / math.sqrt(1 - (ECCENTRICITY * math.sin(_PHI_S)) ** 2)
         / _isometric_py(_PHI_S))


def _ellipsoid_term(phi: Column) -> Column:
    es = F.sin(phi) * ECCENTRICITY
    return F.pow((1 - es) / (1 + es), F.lit(ECCENTRICITY / 2))


def grid_position(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(column, row) in the radar grid, in km."""
    phi = F.radians(lat)
    rho = F.tan(F.lit(math.pi / 4) - phi / 2) / _ellipsoid_term(phi) * SCALE
    lam = F.radians(lon - CENTRAL_LONGITUDE)
    return (rho * F.sin(lam) + FALSE_X) / 1000, (rho * F.cos(lam) - FALSE_Y) / 1000


def with_grid(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    x, y = grid_position(F.col(lon), F.col(lat))
    return df.withColumns({"gx": x, "gy": y})


def with_lonlat(df: DataFrame, gx: str = "gx", gy: str = "gy", steps: int = 8) -> DataFrame:
    """Inverse of ``with_grid``; the latitude by a fixed number of iterations.

    Every step is a projection of its own. Nested in one expression the tree would double
    with each step.
    """
    east, south = F.col(gx) * 1000 - FALSE_X, F.col(gy) * 1000 + FALSE_Y
    out = df.withColumn("_t", F.hypot(east, south) / SCALE)
    out = out.withColumn("_phi", F.lit(math.pi / 2) - F.atan("_t") * 2)
    for _ in range(steps):
        out = out.withColumn(
            "_phi", F.lit(math.pi / 2) - F.atan(F.col("_t") * _ellipsoid_term(F.col("_phi"))) * 2)
    return out.withColumns({
        "lon": F.degrees(F.atan2(east, south)) + CENTRAL_LONGITUDE, "lat": F.degrees("_phi"),
    }).drop("_t", "_phi")


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half_lat = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2))
    half_lon = F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    inner = half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon
    return F.asin(F.sqrt(inner)) * (2 * EARTH_RADIUS_KM)


def sun_elevation(seconds: Column, lat: Column, lon: Column) -> Column:
    """Degrees above the horizon; seconds since 1970 UTC."""
    d = seconds / 86400.0 - 10957.5
    g = F.radians(d * 0.98560028 + 357.529)
    ecliptic = F.radians(
        d * 0.98564736 + 280.459 + F.sin(g) * 1.915 + F.sin(g * 2) * 0.02)
    tilt = F.radians(F.lit(23.439) - d * 0.00000036)
    right_ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    hour_angle = F.radians(d * 360.98564736629 + 280.46061837 + lon) - right_ascension
    phi = F.radians(lat)
    return F.degrees(F.asin(
        F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour_angle)))


def with_daylight(df: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """``hell``: the flag given, else the sun at mid-hour, without a place 7 to 19 h local."""
    start = F.unix_timestamp("zeit")
    by_sun = sun_elevation(start + 1800, F.col("lat"), F.col("lon")) > SUN_ON_HORIZON
    hour = F.hour(F.from_utc_timestamp("zeit", zone))
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return df.withColumn("hell", F.coalesce(
        F.col("ist_tag"), F.when(placed, by_sun).otherwise((hour >= 7) & (hour < 19))))


def rain_rate(raw: Column) -> Column:
    """Hundredths of a millimetre in five minutes -> mm/h."""
    return raw * 12 / 100


def rain_class(rate: Column) -> Column:
    """Index of the highest lower bound reached, NULL below the first."""
    out = F.when(rate >= RAIN_CLASSES[-1], F.lit(len(RAIN_CLASSES) - 1))
    for i in range(len(RAIN_CLASSES) - 2, -1, -1):
        out = out.when(rate >= RAIN_CLASSES[i], F.lit(i))
    return out


def with_rain_class(df: DataFrame, raw: str = "raw") -> DataFrame:
    return df.withColumn("mm_h", rain_rate(F.col(raw))).withColumn(
        "klasse", rain_class(F.col("mm_h")))
