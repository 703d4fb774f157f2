"""Places: radius and box search, radius joins, narrowest boxes and longitudes along a path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions import geo


def near(places: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Places within km of a point, with their distance. Degrees are compared before distances."""
    rows = places.filter(geo.may_be_near(F.col("lat"), F.col("lon"), lat, lon, km))
    distance = geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return rows.withColumn("distance_km", distance).filter(F.col("distance_km") <= km)


def in_box(places: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    return places.filter(geo.in_box(F.col("lat"), F.col("lon"), min_lon, min_lat, max_lon, max_lat))


def near_join(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs of places (id, lat, lon) within km. Points meet on grid cells: an equi-join on the left
    cell and the right cell's neighbourhood, then the exact distance. Cells are bands of latitude of km
    in height, cut into longitudes as wide as km is at the band's end nearest a pole; a band where that is
    a third of the circle or more, and its neighbours' reach into it, is one cell. Columns wrap."""
    step = km / geo.LAT_DEGREE
    band = lambda lat: F.floor((lat + 90) / step)

    def columns(b: Column) -> Column:
        # A band's columns suit its neighbours too: their points lie up to two bands nearer the pole.
        edge = F.greatest(F.abs(b * step - 90 - step), F.abs((b + 2) * step - 90))
        width = F.when(edge < 89, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(km / geo.RADIUS / 2)) / F.cos(F.radians(edge))))) * 2)
        return F.when(width < 120, F.floor(360 / width)).otherwise(1)

    l = left.select("id", "lat", "lon", band(F.col("lat")).alias("band"))
    l = l.withColumn("col", F.pmod(F.floor((F.col("lon") + 180) / 360 * columns(F.col("band"))), columns(F.col("band"))))
    r = right.select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(F.array(*[band(F.col("lat")) + i for i in (-1, 0, 1)])).alias("band"))
    n = columns(F.col("band"))
    at = F.floor((F.col("lon2") + 180) / 360 * n)
    r = r.withColumn("col", F.explode(F.array_distinct(F.array(*[F.pmod(at + i, n) for i in (-1, 0, 1)]))))
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return l.join(r, ["band", "col"]).withColumn("distance_km", d).filter(F.col("distance_km") <= km).drop("band", "col")


@F.pandas_udf(DoubleType())
def polygon_distance_km(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Distance of (lat, lon) to a polygon given as an array of (lon, lat): 0 inside, else to its
    planar nearest point in degrees, measured on the sphere."""
    for lat, lon, ring in batches:
        yield pd.Series([_polygon_km(a, o, r) for a, o, r in zip(lat, lon, ring, strict=True)], dtype="float64")


def _polygon_km(lat: float, lon: float, ring: list) -> float:
    p = np.array([[q["lon"], q["lat"]] for q in ring], float)
    a, b = p, np.roll(p, -1, axis=0)
    crosses = ((a[:, 1] > lat) != (b[:, 1] > lat)) & (lon < (b[:, 0] - a[:, 0]) * (lat - a[:, 1]) / np.where(b[:, 1] == a[:, 1], 1, b[:, 1] - a[:, 1]) + a[:, 0])
    if crosses.sum() % 2:
        return 0.0
    ab = b - a
    t = np.clip((((lon, lat) - a) * ab).sum(axis=1) / np.maximum((ab**2).sum(axis=1), 1e-18), 0, 1)
    q = a + t[:, None] * ab
    x, y = q[((q - (lon, lat)) ** 2).sum(axis=1).argmin()]
    p1, p2 = np.radians(lat), np.radians(y)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(x - lon) / 2) ** 2
    return float(2 * geo.RADIUS * np.arcsin(np.sqrt(min(1.0, h))))


def area_hits(places: DataFrame, lat: float, lon: float, km: float, times: float = 10.0) -> DataFrame:
    """Places in a marked circle: inside, or containing it where the place's own area is much larger
    (column area_km2)."""
    circle = 3.141592653589793 * km * km
    return near(places, lat, lon, km).withColumn("hit", F.when(F.col("area_km2") > times * circle, "contains").otherwise("inside"))


def narrowest_box(places: DataFrame, by: list[str]) -> DataFrame:
    """Per group, west and east of the narrowest box: the one that leaves out the widest gap between
    neighbouring longitudes, across the 180th meridian too."""
    w = W.partitionBy(*by).orderBy("lon")
    whole = W.partitionBy(*by)
    lons = places.select(*by, "lon").distinct().withColumn("next", F.lead("lon").over(w)).withColumn("least", F.min("lon").over(whole))
    gap = F.coalesce(F.col("next") - F.col("lon"), F.col("least") + 360 - F.col("lon"))
    best = F.max_by(F.struct(F.coalesce("next", "least").alias("west"), F.col("lon").alias("east")), F.struct(gap, -F.col("lon")))
    return lons.groupBy(*by).agg(best.alias("box")).select(*by, "box.west", "box.east")


def unwrap(path: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Longitudes along a path without jumps at the 180th meridian."""
    w = W.partitionBy(*by).orderBy(*order)
    jump = F.col("lon") - F.lag("lon").over(w)
    turn = F.when(jump > 180, -360).when(jump < -180, 360).otherwise(0)
    return path.withColumn("turn", F.coalesce(turn, F.lit(0))).withColumn("unwrapped", F.col("lon") + F.sum("turn").over(w)).drop("turn")


def line_strings(path: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Points of a path as a GeoJSON LineString."""
    points = F.transform(F.array_sort(F.collect_list(F.struct(seq, "lon", "lat"))), lambda p: F.array(p["lon"], p["lat"]))
    return path.groupBy(*by).agg(F.to_json(F.struct(F.lit("LineString").alias("type"), points.alias("coordinates"))).alias("geometry"))


def far_from(events: DataFrame, places: DataFrame, km: Column | float) -> DataFrame:
    """Events (id, lat, lon) whose own point is further than km from every place (id, place_lat, place_lon) of theirs."""
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))
    return events.join(places, "id").groupBy("id").agg(F.min(d).alias("distance_km")).filter(F.col("distance_km") > km)
