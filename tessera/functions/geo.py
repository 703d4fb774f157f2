"""Spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in km: mean radius, least length of a degree of latitude, degree of longitude at the equator.
RADIUS, LAT_DEGREE, LON_DEGREE = 6371.0, 110.5, 111.32


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def in_box(lat: Column, lon: Column, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> Column:
    """A box with min_lon > max_lon crosses the 180th meridian."""
    across = lon.between(min_lon, max_lon) if min_lon <= max_lon else (lon >= min_lon) | (lon <= max_lon)
    return lat.between(min_lat, max_lat) & across


def may_be_near(lat: Column, lon: Column, at_lat: float, at_lon: float, km: float) -> Column:
    """A superset of the points within km: a comparison of degrees, pushed down to the scan."""
    dlat = km / LAT_DEGREE + 1e-9
    ok = lat.between(at_lat - dlat, at_lat + dlat)
    cos = math.cos(math.radians(min(abs(at_lat) + dlat, 90.0)))
    dlon = km / (LON_DEGREE * cos) if cos > 1e-6 else 360.0
    if dlon >= 180:
        return ok
    low, high = at_lon - dlon, at_lon + dlon
    if low < -180 or high > 180:
        return ok & ((lon >= (low + 180) % 360 - 180) | (lon <= (high + 180) % 360 - 180))
    return ok & lon.between(low, high)


def cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Grid cell as an equi-join key."""
    columns = math.ceil(360 / degrees)
    return (F.floor((lat + 90) / degrees) * columns + F.pmod(F.floor((lon + 180) / degrees), F.lit(columns))).cast("long")


def box_area_km2(width: Column, height: Column, middle_lat: Column) -> Column:
    return width * height * LON_DEGREE**2 * F.cos(F.radians(middle_lat))
