"""Thermal detections near facilities: sessions, routine flares, and labels from the site's own history."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import THERMAL
from ..functions.geo import cell_of, cells_within, distance_to_polygon_km, grid_cell, haversine_km
from ..functions.text import short_hash
from ..operators.past_ranks import past_ranks
from ..operators.timeline import sessionize
from ..session import cut_lineage


def detection_id(source: Column, lat: Column, lon: Column, day: Column, hhmm: Column, satellite: Column) -> Column:
    return short_hash(20, source, F.format_string("%.5f", lat), F.format_string("%.5f", lon), day,
                      F.lpad(hhmm.cast("int").cast("string"), 4, "0"), F.coalesce(satellite, F.lit("")))


def detections_at_sites(det: DataFrame, sites: DataFrame, km: float, cell_deg: float = 0.25) -> DataFrame:
    """Detections within ``km`` of a site's polygon (0 inside, else distance to its vertices).

    sites: site_id, rings. Each vertex names the cells around it, and so does the box between them, so the
    join is an equality on cells.
    """
    corners = sites.select("site_id", "rings", F.explode(F.flatten("rings")).alias("p"))
    around = corners.select("site_id", "rings", F.explode(cells_within(
        F.col("p.lon"), F.col("p.lat"), km, cell_deg)).alias("_cell"))
    flat = F.flatten("rings")
    lons, lats = F.transform(flat, lambda p: p["lon"]), F.transform(flat, lambda p: p["lat"])
    n_lon = round(360.0 / cell_deg)
    xs = F.sequence(F.floor((F.array_min(lons) + 180) / cell_deg).cast("long"),
                    F.floor((F.array_max(lons) + 180) / cell_deg).cast("long"))
    ys = F.sequence(F.floor((F.array_min(lats) + 90) / cell_deg).cast("long"),
                    F.floor((F.array_max(lats) + 90) / cell_deg).cast("long"))
    inside = sites.select("site_id", "rings", F.explode(F.flatten(F.transform(ys, lambda y: F.transform(
        xs, lambda x: F.struct(F.pmod(x, F.lit(n_lon)).alias("cx"), y.alias("cy")))))).alias("_cell"))
    cells = around.unionByName(inside).dropDuplicates(["site_id", "_cell"])
    d = det.withColumn("_cell", cell_of(F.col("lon"), F.col("lat"), cell_deg)).join(cells, "_cell")
    # A generator keeps the filter from taking a second copy of the distance below itself.
    d = d.withColumn("distance_km", F.explode(F.array(distance_to_polygon_km(F.col("lon"), F.col("lat"), F.col("rings")))))
    return d.where(F.col("distance_km") <= km).drop("_cell", "rings")


def persistent_cells(site_det: DataFrame, at: str = "acq_datetime", cell_deg: float = 0.004, min_share: float = 0.3,
                     min_days: int = 10) -> DataFrame:
    """Grid cells lit on at least ``min_share`` of a site's days with any detection."""
    daily = site_det.select("site_id", grid_cell(F.col("lon"), cell_deg).alias("cx"),
                            grid_cell(F.col("lat"), cell_deg).alias("cy"), F.to_date(at).alias("day")).distinct()
    cells = daily.groupBy("site_id", "cx", "cy").agg(F.count("*").alias("n_days"))
    days = daily.select("site_id", "day").distinct().groupBy("site_id").agg(F.count("*").alias("site_days"))
    c = cells.join(days, "site_id").withColumn("share", F.col("n_days") / F.col("site_days"))
    return c.where((F.col("site_days") >= min_days) & (F.col("share") >= min_share))


def mark_routine(site_det: DataFrame, cells: DataFrame, flares: DataFrame | None = None, cell_deg: float = 0.004,
                 flare_km: float = 0.5) -> DataFrame:
    """Flag detections in a persistent cell or near a listed flare point (site_id, flares array)."""
    d = site_det.withColumns({"cx": grid_cell(F.col("lon"), cell_deg), "cy": grid_cell(F.col("lat"), cell_deg)})
    d = d.join(cells.select("site_id", "cx", "cy", F.lit(True).alias("_p")), ["site_id", "cx", "cy"], "left")
    near = F.lit(False)
    if flares is not None:
        d = d.join(flares.select("site_id", "flares"), "site_id", "left")
        near = F.coalesce(F.exists("flares", lambda p: haversine_km(
            F.col("lon"), F.col("lat"), p["lon"], p["lat"]) <= flare_km), F.lit(False))
    return d.withColumn("routine", F.coalesce("_p", F.lit(False)) | near).drop("_p", "flares", "cx", "cy")


def thermal_events(site_det: DataFrame, gap_seconds: int = 3600, at: str = "acq_datetime") -> DataFrame:
    """One row per site and session. site_det carries routine, source, satellite, daynight, frp."""
    s = sessionize(site_det, ["site_id"], at, gap_seconds, ["det_id"], bucket_seconds=21_600)
    per_class = s.groupBy("site_id", "session_no", "daynight").agg(
        F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"), F.max("frp").alias("frp"),
        F.count_if("routine").alias("r"), F.collect_set("source").alias("src"), F.collect_set("satellite").alias("sat"))
    return per_class.groupBy("site_id", "session_no").agg(
        F.min("lo").alias("start_at"), F.max("hi").alias("end_at"), F.sum("n").alias("n_detections"),
        F.size(F.array_distinct(F.flatten(F.collect_list("sat")))).alias("n_satellites"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("src")))), ",").alias("sensors"),
        F.max("frp").alias("max_frp"), (F.sum("r") / F.sum("n")).alias("routine_share"),
        # The most frequent class; among equals the first in the alphabet.
        F.min_by("daynight", F.struct((-F.col("n")).alias("a"), F.col("daynight").alias("b"))).alias("daynight"))


def _ranks_near(n: Column, q: float) -> Column:
    """The ranks that decide the quantile of ``n`` values, and that of the same values and one more."""
    alone, one_more = F.lit(float(q)) * (n - 1), F.lit(float(q)) * n
    near = [f(p).cast("long") for p in (alone, one_more) for f in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*near, near[2] - 1, near[3] - 1))


def _quantile_with(ranks: str, n: Column, extra: Column, q: float) -> Column:
    """Linear quantile of ``n`` values known by the map ``ranks``, together with ``extra`` where it is not null.

    With one value more, the k-th is the larger of the (k - 1)-th before and the smaller of the k-th before and the new one.
    """
    def at(k: Column) -> Column:
        return F.try_element_at(ranks, k)
    place = F.lit(float(q)) * F.when(extra.isNull(), n - 1).otherwise(n)
    lo, hi = F.floor(place).cast("long"), F.ceil(place).cast("long")
    a, b = (F.when(extra.isNull(), at(k)).otherwise(F.greatest(at(k - 1), F.least(at(k), extra))) for k in (lo, hi))
    return a + (b - a) * (place - lo)


def label_events(events: DataFrame, site_det: DataFrame, cfg: Mapping = THERMAL, at: str = "acq_datetime") -> DataFrame:
    """Label each event from detections of its class at its site more than a day before it.

    History is one row per site, class and day. The day the cut falls into counts only up to the cut: a
    running count inside that day supplies it. Of all earlier days only the ranks next to the quantile are
    asked, with and without that one value more, so no event carries its past.
    """
    q, min_days, routine_at = cfg["quantile"], cfg["min_baseline_days"], cfg["routine_share_threshold"]
    k = ["site_id", "daynight"]
    d = site_det.withColumn("day", F.to_date(at))
    daily = cut_lineage(d.groupBy(*k, "day").agg(F.count("*").alias("n"), F.max("frp").alias("frp")))
    ev = events.withColumn("_cut", F.col("start_at") - F.expr("INTERVAL 1 DAY"))
    ev = cut_lineage(ev.withColumn("day", F.to_date("_cut")))
    axis = ev.select(*k, "day").distinct().withColumn("_asked", F.lit(True)).join(daily, k + ["day"], "full_outer")
    past = Window.partitionBy(*k).orderBy(F.unix_date("day")).rangeBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("n").isNotNull(), F.col("day"))
    axis = cut_lineage(axis.withColumns({
        "_counts": F.count("n").over(past), "_frps": F.count("frp").over(past), "_first": F.min(seen).over(past),
        "_last": F.max(seen).over(past)}).where("_asked").drop("_asked", "n", "frp"))
    facts = daily.select(*k, "day", F.explode(F.array(
        F.struct(F.lit("n").alias("m"), F.col("n").cast("double").alias("v")), F.struct(F.lit("frp").alias("m"), F.col("frp").alias("v")))).alias("f")).select(*k, "day", "f.*")
    asks = axis.select(*k, "day", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), _ranks_near(F.col(c), q).alias("ranks")) for m, c in (
        ("n", "_counts"), ("frp", "_frps"))])).alias("a")).select(*k, "day", "a.*")
    found = past_ranks(facts, asks, k + ["m"], "day", "v", "ranks").groupBy(*k, "day").agg(
        F.max_by("found", F.when(F.col("m") == "n", 1)).alias("_nmap"), F.max_by("found", F.when(F.col("m") == "frp", 1)).alias("_fmap"))
    # Detections of the cut's own day before the cut. Sessions lie a gap apart, so a day has at most
    # 86,400 / gap cuts; the products are counted in place by partial aggregation.
    partial = (d.select(*k, "day", F.col(at).alias("_t"), "frp").join(ev.select(*k, "day", "session_no", "_cut"), k + ["day"])
               .where(F.col("_t") < F.col("_cut")).groupBy(*k, "session_no")
               .agg(F.count("*").alias("_pn"), F.max("frp").alias("_pf")))
    e = ev.join(axis.join(found, k + ["day"], "left"), k + ["day"], "left").join(partial, k + ["session_no"], "left")
    has = F.col("_pn").isNotNull()
    n, nf = F.coalesce("_counts", F.lit(0)), F.coalesce("_frps", F.lit(0))
    e = e.withColumns({
        "history_days": (n + has.cast("int")).cast("int"), "count_quantile": _quantile_with("_nmap", n, F.col("_pn").cast("double"), q),
        "frp_quantile": _quantile_with("_fmap", nf, F.col("_pf"), q),
        "span_days": F.datediff(F.when(has, F.col("day")).otherwise(F.col("_last")),
                                F.coalesce("_first", F.when(has, F.col("day")))) + 1})
    above = (F.col("n_detections") > F.col("count_quantile")) | (F.col("max_frp") > F.col("frp_quantile"))
    label = (F.when(F.col("routine_share") >= routine_at, "routine_flaring_pattern")
             .when(F.col("history_days") < 5, "insufficient_baseline")
             .when(F.col("span_days") < min_days, "insufficient_baseline")
             .when(above, "thermal_anomaly_near_facility").otherwise("within_site_thermal_baseline"))
    return e.withColumn("classification", label).drop("_cut", "day", "_counts", "_frps", "_first", "_last", "_nmap", "_fmap", "_pn", "_pf")


def label_detections(at_site: DataFrame, sites: DataFrame, cfg: Mapping = THERMAL, gap_seconds: int = 3600, min_share: float = 0.3) -> DataFrame:
    """Labelled events of detections near sites. Those are stored once, since cells, sessions and history all read them."""
    at_site = cut_lineage(at_site)
    marked = mark_routine(at_site, persistent_cells(at_site, min_share=min_share), sites)
    return label_events(thermal_events(marked, gap_seconds), marked, cfg)


def build_thermal_events(det: DataFrame, sites: DataFrame, cfg: Mapping = THERMAL) -> DataFrame:
    """Detections -> labelled events. sites: site_id, rings, flares."""
    return label_detections(detections_at_sites(det, sites, cfg["buffer_km"]), sites, cfg)
