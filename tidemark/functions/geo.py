"""Geometry columns. A geometry is array<array<struct<lon,lat>>>: outer ring first, holes after it.

A multipolygon is an array of such polygons. Only built-in expressions are used.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_KM

KM_PER_DEGREE = 111.32


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule: count the edges a ray to the east crosses."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a = F.element_at(ring, i)
        b = F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        rise = F.when(b["lat"] == a["lat"], F.lit(1e-12)).otherwise(b["lat"] - a["lat"])
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        return straddles & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / rise + a["lon"])

    hits = F.size(F.filter(F.sequence(F.lit(1), n), crosses))
    return F.when(n > 0, hits % 2 == 1).otherwise(F.lit(False))


def in_polygon(lon: Column, lat: Column, rings: Column) -> Column:
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(lon, lat, F.get(rings, 0)) & ~F.exists(holes, lambda h: in_ring(lon, lat, h))


def in_multipolygon(lon: Column, lat: Column, polygons: Column) -> Column:
    return F.exists(polygons, lambda rings: in_polygon(lon, lat, rings))


def distance_to_polygon_km(lon: Column, lat: Column, rings: Column) -> Column:
    """0 inside, else the distance to the nearest vertex (not to the nearest edge)."""
    corner = F.array_min(F.transform(F.flatten(rings), lambda p: haversine_km(lon, lat, p["lon"], p["lat"])))
    return F.when(in_polygon(lon, lat, rings), F.lit(0.0)).otherwise(corner)


def bounding_box(points: Column) -> Column:
    lons = F.transform(points, lambda p: p["lon"])
    lats = F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(lons).alias("west"), F.array_min(lats).alias("south"),
                    F.array_max(lons).alias("east"), F.array_max(lats).alias("north"))


def buffered_box(box: Column, km: float) -> Column:
    dlat = km / KM_PER_DEGREE
    mid = (box["south"] + box["north"]) / 2
    dlon = F.lit(km) / (KM_PER_DEGREE * F.greatest(F.lit(0.1), F.cos(F.radians(mid))))
    return F.struct((box["west"] - dlon).alias("west"), (box["south"] - dlat).alias("south"),
                    (box["east"] + dlon).alias("east"), (box["north"] + dlat).alias("north"))


def grid_cell(v: Column, cell_deg: float) -> Column:
    """Nearest grid line, halves to even."""
    return F.rint(v / F.lit(cell_deg)).cast("long")


def polygon_wkt(rings: Column) -> Column:
    pts = F.transform(F.get(rings, 0), lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    return F.concat(F.lit("POLYGON(("), F.array_join(pts, ", "), F.lit("))"))


def wkt_ring(wkt: Column) -> Column:
    """Outer ring of a POLYGON text as array<struct<lon,lat>>."""
    body = F.regexp_extract(wkt, r"(?i)POLYGON\s*\(+([^()]*)\)", 1)
    pairs = F.split(F.trim(body), r"\s*,\s*")
    return F.when(body != "", F.transform(pairs, lambda s: F.struct(
        F.get(F.split(s, r"\s+"), 0).cast("double").alias("lon"),
        F.get(F.split(s, r"\s+"), 1).cast("double").alias("lat"))))


def footprint_text(text: Column) -> Column:
    """The WKT part of a provider footprint, null when there is none."""
    return F.nullif(F.regexp_extract(text, r"(?is)((?:MULTI)?POLYGON\s*\(.*\))", 1), F.lit(""))


def _box_reach(lat: Column, km: float) -> tuple[float, Column]:
    """Half height and half width in degrees of the smallest box around a radius."""
    r = km / EARTH_RADIUS_KM
    dlat = math.degrees(r)
    ratio = F.lit(math.sin(r)) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    near_pole = (F.abs(lat) + dlat >= 90.0) | (ratio >= 1.0)
    return dlat, F.when(near_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))


def cell_of(lon: Column, lat: Column, cell_deg: float) -> Column:
    """Containing cell; longitudes wrap at the date line."""
    n_lon = round(360.0 / cell_deg)
    return F.struct(F.pmod(F.floor((lon + 180.0) / cell_deg).cast("long"), F.lit(n_lon)).alias("cx"),
                    F.floor((lat + 90.0) / cell_deg).cast("long").alias("cy"))


def cells_within(lon: Column, lat: Column, km: float, cell_deg: float) -> Column:
    """All cells a circle of the radius can touch. 360 must be a multiple of cell_deg."""
    n_lon = round(360.0 / cell_deg)
    dlat, dlon = _box_reach(lat, km)
    west = F.floor((lon - dlon + 180.0) / cell_deg).cast("long")
    east = F.floor((lon + dlon + 180.0) / cell_deg).cast("long")
    cols = F.array_distinct(F.transform(F.sequence(west, east), lambda c: F.pmod(c, F.lit(n_lon))))
    south = F.floor((F.greatest(lat - dlat, F.lit(-90.0)) + 90.0) / cell_deg).cast("long")
    north = F.floor((F.least(lat + dlat, F.lit(90.0)) + 90.0) / cell_deg).cast("long")
    return F.flatten(F.transform(F.sequence(south, north), lambda y: F.transform(
        cols, lambda x: F.struct(x.alias("cx"), y.alias("cy")))))
