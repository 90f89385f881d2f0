"""Spatial joins on grid cells, polygon overlap, and exact greedy thinning."""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell_of, cells_within, haversine_km
from ..session import cut_lineage


def radius_join(points: DataFrame, sites: DataFrame, km: float, cell_deg: float = 0.25, lon: str = "lon", lat: str = "lat",
                site_lon: str = "site_lon", site_lat: str = "site_lat") -> DataFrame:
    """Points within ``km`` of sites, with the distance.

    A site names every cell its circle touches, a point names its own: an equality join. Small site
    tables are broadcast by their statistics; larger ones are shuffled and AQE splits a crowded cell.
    """
    s = sites.withColumn("_cell", F.explode(cells_within(F.col(site_lon), F.col(site_lat), km, cell_deg)))
    p = points.withColumn("_cell", cell_of(F.col(lon), F.col(lat), cell_deg))
    d = haversine_km(F.col(lon), F.col(lat), F.col(site_lon), F.col(site_lat))
    return p.join(s, "_cell").withColumn("distance_km", d).where(F.col("distance_km") <= km).drop("_cell")


def near_any(points: DataFrame, key: str, sites: DataFrame, km: float, name: str, cell_deg: float = 0.25) -> DataFrame:
    """Points with a flag: is any site within the distance? Asked once per distinct place, of distinct sites; ``key`` names a point."""
    places = points.select("lon", "lat").distinct()
    hit = radius_join(places, sites.select("site_lon", "site_lat").distinct(), km, cell_deg).select("lon", "lat").distinct()
    return points.join(hit.withColumn(name, F.lit(True)), ["lon", "lat"], "left").select(*points.columns, F.coalesce(name, F.lit(False)).alias(name))


def thin_by_distance(candidates: DataFrame, group: Sequence[str], key: str, rank: Column, km: float,
                     blocks: Column, cell_deg: float | None = None) -> DataFrame:
    """Greedy thinning: walk candidates by falling rank, keep one unless a kept one lies nearer than ``km``.

    Rows where ``blocks`` is false (already rejected or masked) are kept and block nobody.

    The walk is sequential by nature; the same result comes from rounds. In a round a candidate is
    certainly kept if no undecided one of higher rank sits in any cell its circle touches; everything
    near a newly kept one is dropped. Only the top candidate of a cell is compared, so a cell with any
    number of candidates sends one row, and all pairs are never formed. Every round decides at least the highest candidate
    of each group, and rounds go on until none is undecided.
    """
    if cell_deg is None:                                        # few candidates stay in a cell, and a circle touches few cells
        cell_deg = 360.0 / math.ceil(360.0 * 111.2 / (2 * km))
    g = list(group)
    tagged = candidates.withColumns({"_rank": F.struct(rank.alias("r"), F.col(key).alias("k")), "_blocks": blocks})
    free = candidates.where(~blocks)
    tops = tagged.where("_blocks").groupBy(*g, "lon", "lat").agg(F.max("_rank").alias("_rank"))
    # Places are numbered in order of rank once: the rounds compare and join plain numbers.
    places = cut_lineage(tops.orderBy("_rank").select(*g, F.monotonically_increasing_id().alias("_no"), F.col("_rank.k").alias(key), "lon", "lat", cell_of(F.col("lon"), F.col("lat"), cell_deg).alias("_cell")))
    undecided = places.drop(key)
    kept_parts = [undecided.select("_no").where(F.lit(False))]
    while undecided.limit(1).count():
        if len(kept_parts) > 20:                                # a long ridge takes many rounds; the plan stays small
            kept_parts = [cut_lineage(reduce(DataFrame.unionByName, kept_parts))]
        tops = undecided.groupBy(*g, "_cell").agg(F.max("_no").alias("_top"))
        asking = undecided.join(tops.select(F.col("_top").alias("_no")), "_no", "left_semi")
        looks = asking.select(*g, "_no", F.explode(cells_within(F.col("lon"), F.col("lat"), km, cell_deg)).alias("_cell"))
        beaten = looks.join(tops, g + ["_cell"]).where(F.col("_top") > F.col("_no")).select("_no")
        won = cut_lineage(asking.join(beaten, "_no", "left_anti").select(*g, F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col("_no").alias("_won")))
        kept_parts.append(won.select(F.col("_won").alias("_no")))
        reach = won.withColumn("_cell", F.explode(cells_within(F.col("_lon"), F.col("_lat"), km, cell_deg)))
        near = haversine_km(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")) < km
        gone = undecided.join(reach, g + ["_cell"]).where(near | (F.col("_no") == F.col("_won"))).select("_no")
        undecided = cut_lineage(undecided.join(gone, "_no", "left_anti"))
    kept = places.join(reduce(DataFrame.unionByName, kept_parts), "_no").select(key)
    return free.unionByName(candidates.where(blocks).join(kept, key, "left_semi").select(*candidates.columns))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a one-element array makes it a lambda variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _next(ring: Column) -> Column:
    """The ring turned by one point, so that zipping pairs each point with the one after it."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _open(ring: Column) -> Column:
    """A ring without the repeat of its first point at the end."""
    closed = F.element_at(ring, 1) == F.element_at(ring, -1)
    return F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def _doubled_area(ring: Column) -> Column:
    """Twice the signed area of an open ring; positive where it turns left."""
    terms = F.zip_with(ring, _next(ring), lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"])
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def _cut(ring: Column, edge: Column) -> Column:
    """The part of an open ring on the left of a directed edge (a, b)."""
    a, b = edge["a"], edge["b"]

    def side(p: Column) -> Column:
        return (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (p["lon"] - a["lon"])

    none = F.slice(ring, 1, 0)
    sides = F.zip_with(ring, _next(ring), lambda p, q: F.struct(p.alias("p"), q.alias("q"), side(p).alias("sp"), side(q).alias("sq")))

    def stay(x: Column) -> Column:
        share = x["sp"] / (x["sp"] - x["sq"])
        met = F.struct(*[(x["p"][c] + share * (x["q"][c] - x["p"][c])).alias(c) for c in ("lon", "lat")])
        return F.concat(F.when(x["sp"] >= 0, F.array(x["p"])).otherwise(none), F.when(x["sp"] * x["sq"] < 0, F.array(met)).otherwise(none))
    return F.flatten(F.transform(sides, stay))


def overlap_fraction(scene: str | Column, area: str | Column) -> Column:
    """Area of (scene and area) over area, for rings as array<struct<lon,lat>>; the area must be convex, in either direction.

    The area's edges cut the scene one after the other inside one aggregate, without leaving the JVM. Null where a ring is
    unknown, has fewer than three points, or the area has no extent; 0 where they do not meet.
    """
    ring = "array<struct<lon:double,lat:double>>"
    scene, area = (F.col(c) if isinstance(c, str) else c for c in (scene, area))
    known = (F.size(scene) >= 3) & (F.size(area) >= 3)
    both = F.struct(_open(scene.cast(ring)).alias("scene"), _open(area.cast(ring)).alias("area"))

    def fraction(r: Column) -> Column:
        left = F.when(_doubled_area(r["area"]) < 0, F.reverse(r["area"])).otherwise(r["area"])
        edges = _bound(left, lambda w: F.zip_with(w, _next(w), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
        covered = _bound(F.aggregate(edges, r["scene"], _cut), _doubled_area)
        return F.abs(covered) / F.nullif(F.abs(_doubled_area(r["area"])), F.lit(0.0))
    return F.when(known, _bound(both, fraction))
