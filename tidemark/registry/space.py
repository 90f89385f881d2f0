"""Spatial joins, heat events, scene coverage, pixel change and candidates."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions import geo as G
from ..operators.spatial import near_any, overlap_fraction, radius_join
from ..operators.timeline import sessionize
from ..plans import scenes as S
from ..plans import thermal as TH
from .base import query

HAV = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians({3}) - radians({1})) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin(radians({2} - {0}) / 2), 2))))"
POINTS = """WITH c AS (SELECT c_custkey, (c_custkey * 7919 % 36000) / 100.0 - 180.0 AS lon, (c_custkey * 104729 % 16000) / 100.0 - 80.0 AS lat FROM customer),
 s AS (SELECT s_suppkey, (s_suppkey * 6121 % 36000) / 100.0 - 180.0 AS slon, (s_suppkey * 50021 % 16000) / 100.0 - 80.0 AS slat FROM supplier)"""
DIST = HAV.format("CAST(lon AS DOUBLE)", "CAST(lat AS DOUBLE)", "CAST(slon AS DOUBLE)", "CAST(slat AS DOUBLE)")


@query("radius_join", POINTS + f", j AS (SELECT c_custkey, s_suppkey, {DIST} AS d FROM c, s) SELECT c_custkey, s_suppkey, ROUND(d, 3) AS distance_km FROM j WHERE d <= 300")
def radius_join_query(spark, folder):
    j = radius_join(B.customer_points(spark, folder), B.supplier_sites(spark, folder), 300.0, cell_deg=2.0)
    return j.select("c_custkey", "s_suppkey", F.round("distance_km", 3).alias("distance_km"))


@query("flare_proximity", POINTS + f", j AS (SELECT c_custkey, MIN({DIST}) AS d FROM c, s GROUP BY 1) SELECT c_custkey, CAST(d <= 500 AS INTEGER) AS near_flare FROM j")
def flare_proximity(spark, folder):
    n = near_any(B.customer_points(spark, folder), "c_custkey", B.supplier_sites(spark, folder), 500.0, "near", cell_deg=4.0)
    return n.select("c_custkey", F.col("near").cast("int").alias("near_flare"))


RING = [(-60.0, -30.0), (40.0, -50.0), (80.0, 10.0), (20.0, 60.0), (-40.0, 40.0), (-10.0, 5.0), (-60.0, -30.0)]
HOLE = [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0), (0.0, 0.0)]


def _ring(points):
    return F.array(*[F.struct(F.lit(a).alias("lon"), F.lit(b).alias("lat")) for a, b in points])


def _ring_sql(points):
    edges = [f"(CASE WHEN ({bi} > lat) <> ({bj} > lat) AND lon < ({aj} - {ai}) * (lat - {bi}) / {(bj - bi) or 1e-12} + {ai} THEN 1 ELSE 0 END)"
             for (ai, bi), (aj, bj) in zip(points, [points[-1]] + points[:-1])]
    return "((" + " + ".join(edges) + ") % 2 = 1)"


@query("point_in_polygon", POINTS + f""", p AS (SELECT c_custkey, CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat FROM c),
 q AS (SELECT *, {_ring_sql(RING)} AND NOT {_ring_sql(HOLE)} AS inside FROM p)
 SELECT c_custkey, CAST(inside AS INTEGER) AS inside, ROUND(CASE WHEN inside THEN 0 ELSE least({", ".join(HAV.format("lon", "lat", f"({a})", f"({b})") for a, b in RING[:-1] + HOLE[:-1])}) END, 3) AS distance_km FROM q""")
def point_in_polygon(spark, folder):
    rings = F.array(_ring(RING), _ring(HOLE))
    c = B.customer_points(spark, folder)
    return c.select("c_custkey", G.in_polygon(F.col("lon"), F.col("lat"), rings).cast("int").alias("inside"),
                    F.round(G.distance_to_polygon_km(F.col("lon"), F.col("lat"), rings), 3).alias("distance_km"))


@query("grid_cells", POINTS + """ SELECT CAST(round_even(CAST(lon AS DOUBLE) / 0.5, 0) AS BIGINT) AS cx, CAST(round_even(CAST(lat AS DOUBLE) / 0.5, 0) AS BIGINT) AS cy, COUNT(*) AS n FROM c GROUP BY 1, 2""")
def grid_cells(spark, folder):
    c = B.customer_points(spark, folder)
    return c.groupBy(G.grid_cell(F.col("lon"), 0.5).alias("cx"), G.grid_cell(F.col("lat"), 0.5).alias("cy")).agg(F.count("*").alias("n"))


DET = """WITH det AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS det_id, event_type AS source, 'S' || (user_id % 3) AS satellite, ts AS t, user_id % 5 AS si,
   'site' || (user_id % 5) AS site_id, 50.0::DOUBLE + CAST(user_id % 5 AS DOUBLE) + CAST(event_id % 7 AS DOUBLE) * 0.004::DOUBLE AS lon, 26.0::DOUBLE + CAST(event_id % 3 AS DOUBLE) * 0.004::DOUBLE AS lat,
   CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS daynight, value AS frp FROM events),
 s1 AS (SELECT *, CASE WHEN t - LAG(t) OVER w <= INTERVAL {gap} MINUTE THEN 0 ELSE 1 END AS st FROM det WINDOW w AS (PARTITION BY site_id ORDER BY t, det_id)),
 ses AS (SELECT *, SUM(st) OVER (PARTITION BY site_id ORDER BY t, det_id) AS no FROM s1),
 cells AS (SELECT site_id, CAST(round_even(lon / 0.004::DOUBLE, 0) AS BIGINT) AS cx, CAST(round_even(lat / 0.004::DOUBLE, 0) AS BIGINT) AS cy, COUNT(DISTINCT CAST(t AS DATE)) AS n_days FROM det GROUP BY 1, 2, 3),
 sd AS (SELECT site_id, COUNT(DISTINCT CAST(t AS DATE)) AS site_days FROM det GROUP BY 1),
 pc AS (SELECT cells.*, site_days, CAST(n_days AS DOUBLE) / site_days AS share FROM cells JOIN sd USING (site_id) WHERE site_days >= 10 AND CAST(n_days AS DOUBLE) / site_days >= {share})"""


def _det(**kw):
    return DET.format(**{"gap": 10, "share": "0.3", **kw})


@query("thermal_sessions", _det() + " SELECT site_id, no AS session_no, COUNT(*) AS n, CAST(MIN(t) AS VARCHAR) AS start_at, ROUND(MAX(frp), 3) AS max_frp FROM ses GROUP BY 1, 2")
def thermal_sessions(spark, folder):
    d = TH.detections_at_sites(B.detections(spark, folder), B.site_squares(spark), 5.0)
    s = sessionize(d, ["site_id"], "acq_datetime", 600, ["det_id"], bucket_seconds=21_600)
    g = s.groupBy("site_id", "session_no").agg(F.count("*").alias("n"), F.min("acq_datetime").alias("a"), F.max("frp").alias("f"))
    return g.select("site_id", "session_no", "n", F.regexp_replace(F.date_format("a", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "").alias("start_at"), F.round("f", 3).alias("max_frp"))


@query("persistent_cells", _det() + " SELECT site_id, cx, cy, n_days, site_days, ROUND(share, 5) AS share FROM pc")
def persistent_cells_query(spark, folder):
    d = TH.detections_at_sites(B.detections(spark, folder), B.site_squares(spark), 5.0)
    c = TH.persistent_cells(d)
    return c.select("site_id", "cx", "cy", "n_days", "site_days", F.round("share", 5).alias("share"))


CFG = {"quantile": 0.95, "min_baseline_days": 10, "routine_share_threshold": 0.8, "buffer_km": 5.0}
CLASSIFY = _det(share="0.97") + """, f AS (SELECT ses.*, (pc.site_id IS NOT NULL OR (si = 0 AND """ + HAV.format("lon", "lat", "50.0::DOUBLE", "26.0::DOUBLE") + """ <= 0.5)) AS routine FROM ses
   LEFT JOIN pc ON pc.site_id = ses.site_id AND pc.cx = CAST(round_even(lon / 0.004::DOUBLE, 0) AS BIGINT) AND pc.cy = CAST(round_even(lat / 0.004::DOUBLE, 0) AS BIGINT)),
 dn AS (SELECT site_id, no, daynight FROM f GROUP BY 1, 2, 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY site_id, no ORDER BY COUNT(*) DESC, daynight) = 1),
 ev AS (SELECT site_id, no, MIN(t) AS start_at, COUNT(*) AS n, COUNT(DISTINCT satellite) AS n_satellites, MAX(frp) AS max_frp, AVG(CASE WHEN routine THEN 1.0 ELSE 0.0 END) AS rs FROM f GROUP BY 1, 2),
 e AS (SELECT ev.*, dn.daynight FROM ev JOIN dn USING (site_id, no)),
 h AS (SELECT e.site_id, e.no, CAST(f.t AS DATE) AS d, COUNT(*) AS c, MAX(f.frp) AS m FROM e JOIN f ON f.site_id = e.site_id AND f.daynight = e.daynight AND f.t < e.start_at - INTERVAL 1 DAY GROUP BY 1, 2, 3),
 q AS (SELECT site_id, no, COUNT(*) AS days, date_diff('day', MIN(d), MAX(d)) + 1 AS span, QUANTILE_CONT(CAST(c AS DOUBLE), 0.95) AS qc, QUANTILE_CONT(m, 0.95) AS qf FROM h GROUP BY 1, 2)"""


@query("site_classification", CLASSIFY + """ SELECT e.site_id, e.no AS session_no, e.daynight, e.n AS n_detections, e.n_satellites, ROUND(e.rs, 5) AS routine_share, COALESCE(q.days, 0) AS history_days,
 ROUND(q.qc, 5) AS count_quantile, ROUND(q.qf, 5) AS frp_quantile, CASE WHEN e.rs >= 0.8 THEN 'routine_flaring_pattern' WHEN COALESCE(q.days, 0) < 5 OR q.span < 10 THEN 'insufficient_baseline'
 WHEN e.n > q.qc OR e.max_frp > q.qf THEN 'thermal_anomaly_near_facility' ELSE 'within_site_thermal_baseline' END AS classification FROM e LEFT JOIN q USING (site_id, no)""")
def site_classification(spark, folder):
    at = TH.detections_at_sites(B.detections(spark, folder), B.site_squares(spark), CFG["buffer_km"])
    e = TH.label_detections(at, B.site_squares(spark), CFG, 600, 0.97)
    return e.select("site_id", "session_no", "daynight", "n_detections", F.col("n_satellites").cast("bigint").alias("n_satellites"),
                    F.round("routine_share", 5).alias("routine_share"), F.col("history_days").cast("bigint").alias("history_days"),
                    F.round("count_quantile", 5).alias("count_quantile"), F.round("frp_quantile", 5).alias("frp_quantile"), "classification")


def _scenes(spark, folder):
    """Events as a scene catalogue: user = area, event = product."""
    e = B.table(spark, folder, "events")
    t = F.col("ts").cast("timestamp")
    s = e.select(
        F.col("event_id").alias("product_id"), F.when(F.col("event_type").isin("view", "click"), "Sentinel-1").otherwise("Sentinel-2").alias("mission"),
        F.lit("IW_GRDH_1S").alias("product_type"), t.alias("acquisition_start"), t.alias("acquisition_end"),
        (t + F.make_dt_interval(F.lit(0), F.pmod("event_id", F.lit(9)).cast("int"))).alias("published_at"),
        F.pmod("event_id", F.lit(2)).cast("int").alias("relative_orbit"), F.when(F.hour(t) < 12, "DESCENDING").otherwise("ASCENDING").alias("orbit_direction"),
        F.lit("IW").alias("instrument_mode"), F.lit("VV&VH").alias("polarisation"), F.col("value").alias("cloud_cover"),
        F.concat(F.lit("T"), F.pmod("event_id", F.lit(3)).cast("string")).alias("tile_id"))
    a = e.select(F.col("event_id").alias("product_id"), F.col("user_id").alias("aoi_id"),
                 F.when(F.pmod("event_id", F.lit(11)) == 0, None).otherwise(1.0 - F.pmod("event_id", F.lit(10)) / 50.0).alias("intersection_fraction"))
    return s, a


SCENES = """WITH s AS (SELECT event_id AS product_id, user_id AS aoi_id, CASE WHEN event_type IN ('view', 'click') THEN 'Sentinel-1' ELSE 'Sentinel-2' END AS mission, ts AS acq,
   CAST(event_id % 9 AS DOUBLE) AS lat_h, event_id % 2 AS orbit, CASE WHEN hour(ts) < 12 THEN 'DESCENDING' ELSE 'ASCENDING' END AS dir,
   CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1.0::DOUBLE - CAST(event_id % 10 AS DOUBLE) / 50.0::DOUBLE END AS fr, 'T' || (event_id % 3) AS tile, value FROM events),
 u AS (SELECT *, COALESCE(fr, 0) >= 0.9 AS ok FROM s)"""


@query("coverage_gaps", SCENES + """, d AS (SELECT DISTINCT aoi_id, mission, CAST(acq AS DATE) AS day FROM u WHERE ok), g AS (SELECT aoi_id, mission, date_diff('day', LAG(day) OVER (PARTITION BY aoi_id, mission ORDER BY day), day) AS gap FROM d),
 gg AS (SELECT aoi_id, mission, COUNT(*) AS n_usable_days, MEDIAN(gap) AS med, MAX(gap) AS mx FROM g GROUP BY 1, 2),
 b AS (SELECT aoi_id, mission, COUNT(*) AS n_scenes, COUNT(*) FILTER (WHERE ok) AS n_usable, ROUND(MEDIAN(lat_h), 4) AS lat, COUNT(*) FILTER (WHERE fr IS NULL) AS unk, COALESCE(string_agg(DISTINCT CASE WHEN ok THEN tile END, ',' ORDER BY CASE WHEN ok THEN tile END), '') AS tiles FROM u GROUP BY 1, 2)
 SELECT b.aoi_id, b.mission, n_scenes, n_usable, lat AS median_latency_h, unk AS n_fraction_unknown, tiles, COALESCE(n_usable_days, 0) AS n_usable_days, CAST(med AS DOUBLE) AS median_gap_days, mx AS max_gap_days FROM b LEFT JOIN gg USING (aoi_id, mission)""")
def coverage_gaps(spark, folder):
    c = S.coverage_summary(*_scenes(spark, folder))
    return c.select("aoi_id", "mission", "n_scenes", "n_usable", F.round("median_latency_h", 4).alias("median_latency_h"), "n_fraction_unknown", "tiles",
                    "n_usable_days", F.col("median_gap_days").cast("double").alias("median_gap_days"), F.col("max_gap_days").cast("bigint").alias("max_gap_days"))


@query("comparable_groups", SCENES + " SELECT aoi_id, 'rel' || orbit || '-' || substr(dir, 1, 3) || '-IW-VV&VH' AS comparable_group, COUNT(*) AS n_scenes FROM u WHERE ok GROUP BY 1, 2")
def comparable_groups(spark, folder):
    return S.group_counts(*_scenes(spark, folder))


@query("comparable_pairs", SCENES + """, w AS (SELECT aoi_id, product_id AS after_id, LAG(product_id) OVER o AS before_id, orbit <> LAG(orbit) OVER o AS d1, dir <> LAG(dir) OVER o AS d2,
   CASE WHEN fr IS NULL OR fr < 0.9 THEN 1 ELSE 0 END AS lo, LAG(CASE WHEN fr IS NULL OR fr < 0.9 THEN 1 ELSE 0 END) OVER o AS plo, product_id % 40 AS cnt, LAG(product_id % 40) OVER o AS pcnt
   FROM s WINDOW o AS (PARTITION BY aoi_id ORDER BY acq, product_id))
 SELECT aoi_id, before_id, after_id, CAST(d1 AS INTEGER) + CAST(d2 AS INTEGER) + lo + plo AS n_reasons, CASE WHEN NOT d1 AND NOT d2 AND lo + plo = 0 THEN cnt - pcnt END AS difference FROM w WHERE before_id IS NOT NULL""")
def comparable_pairs(spark, folder):
    s, a = _scenes(spark, folder)
    counts = s.join(a.select("product_id", "aoi_id"), "product_id").select("product_id", "aoi_id", "acquisition_start", F.pmod("product_id", F.lit(40)).alias("candidate_count"))
    d = S.snapshot_differences(counts, s, a)
    return d.select("aoi_id", F.col("a.product_id").alias("before_id"), F.col("b.product_id").alias("after_id"), F.size("reasons").cast("bigint").alias("n_reasons"), "difference")


PIX = """WITH r AS (SELECT l_suppkey % 20 AS site_id, l_returnflag AS scene, CASE WHEN l_returnflag = 'R' THEN 'post' ELSE 'pre' END AS role, l_orderkey % 40 AS row, l_partkey % 40 AS col,
   MAX(CAST(ROUND(l_extendedprice) AS BIGINT) % 4000 + 3000) AS b8a, MAX(CAST(l_quantity AS BIGINT) * 40 + 2000) AS b11, MAX(CAST(ROUND(l_extendedprice * 100) AS BIGINT) % 1900 + 100) AS b12,
   MAX(CASE WHEN l_discount >= 0.09 THEN 9 ELSE 4 END) AS scl FROM lineitem GROUP BY 1, 2, 3, 4, 5),
 p AS (SELECT *, row BETWEEN 10 AND 25 AND col BETWEEN 10 AND 25 AS inside, scl = 4 AS ok, CASE WHEN scl = 4 THEN CAST(b8a - b12 AS DOUBLE) / (b8a + b12) END AS nbr FROM r),
 sc AS (SELECT site_id, scene, role, COUNT(*) FILTER (WHERE inside) AS ni, COUNT(*) FILTER (WHERE inside AND ok) AS nu, MIN(row) AS r0, MAX(row) AS r1, MIN(col) AS c0, MAX(col) AS c1 FROM p GROUP BY 1, 2, 3),
 sr AS (SELECT site_id, SUM(CASE WHEN ni = 0 THEN 2 WHEN CAST(nu AS DOUBLE) / ni < 0.7 THEN 1 ELSE 0 END) AS n1, CASE WHEN COUNT(DISTINCT (r0, r1, c0, c1)) > 1 THEN 1 ELSE 0 END AS n2, CASE WHEN COUNT(*) FILTER (WHERE role = 'pre') = 0 THEN 1 ELSE 0 END AS n3 FROM sc GROUP BY 1),
 ring AS (SELECT a.site_id, a.scene, COUNT(*) AS n, MEDIAN(q.b8a) / MEDIAN(a.b8a) AS r8, MEDIAN(q.b11) / MEDIAN(a.b11) AS r11 FROM p a JOIN p q ON q.role = 'post' AND q.site_id = a.site_id AND q.row = a.row AND q.col = a.col
   WHERE a.role = 'pre' AND a.ok AND q.ok AND NOT a.inside AND NOT q.inside GROUP BY 1, 2),
 lt AS (SELECT sc.site_id, SUM(CASE WHEN COALESCE(n, 0) < 50 THEN 1 WHEN r8 BETWEEN 0.8 AND 1.25 AND r11 BETWEEN 0.8 AND 1.25 THEN 0 ELSE 1 END) AS n4 FROM sc LEFT JOIN ring USING (site_id, scene) WHERE sc.role = 'pre' GROUP BY 1),
 pre AS (SELECT site_id, row, col, MEDIAN(nbr) AS m FROM p WHERE role = 'pre' AND nbr IS NOT NULL GROUP BY 1, 2, 3),
 ch AS (SELECT pre.site_id, COUNT(*) AS ev, COUNT(*) FILTER (WHERE m - q.nbr > 0.27) AS cand FROM pre JOIN p q ON q.role = 'post' AND q.site_id = pre.site_id AND q.row = pre.row AND q.col = pre.col WHERE q.inside AND q.nbr IS NOT NULL GROUP BY 1),
 t AS (SELECT sr.site_id, CASE WHEN n1 + n2 + n3 > 0 THEN n1 + n2 + n3 ELSE COALESCE(n4, 0) END AS n_reasons, ch.ev, ch.cand FROM sr LEFT JOIN lt USING (site_id) LEFT JOIN ch USING (site_id))"""


@query("pixel_change", PIX + """ SELECT site_id, CAST(n_reasons AS BIGINT) AS n_reasons, CASE WHEN n_reasons = 0 THEN COALESCE(ev, 0) END AS evaluated_pixels, CASE WHEN n_reasons = 0 THEN COALESCE(cand, 0) END AS candidate_pixels FROM t""")
def pixel_change(spark, folder):
    li = B.table(spark, folder, "lineitem")
    whole = F.round("l_extendedprice").cast("bigint")
    p = li.groupBy(F.pmod("l_suppkey", F.lit(20)).alias("site_id"), F.col("l_returnflag").alias("scene"), F.when(F.col("l_returnflag") == "R", "post").otherwise("pre").alias("role"),
                   F.pmod("l_orderkey", F.lit(40)).alias("row"), F.pmod("l_partkey", F.lit(40)).alias("col")).agg(
        F.max(whole % 4000 + 3000).alias("b8a"), F.max(F.col("l_quantity").cast("bigint") * 40 + 2000).alias("b11"),
        F.max(B.cents("l_extendedprice") % 1900 + 100).alias("b12"), F.max(F.when(F.col("l_discount") >= 0.09, 9).otherwise(4)).alias("scl"))
    p = p.withColumns({"inside": F.col("row").between(10, 25) & F.col("col").between(10, 25), "tile": F.lit("39RXN")})
    c = S.pixel_change(p, min_ring=50)
    return c.select("site_id", F.size("reasons").cast("bigint").alias("n_reasons"), "evaluated_pixels", "candidate_pixels")


def _candidates(spark, folder):
    """Line items as bright pixels of one scene per return flag, crowded enough to need thinning."""
    li = B.table(spark, folder, "lineitem")
    g = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("flag"), F.max("l_extendedprice").alias("x"))
    return g.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("detection_id"), F.col("flag").alias("product_id"),
        F.lit("aoi").alias("aoi_id"), (50.0 + F.pmod("p", F.lit(997)) / 1000.0).alias("lon"), (25.0 + F.pmod(F.col("l_orderkey") * 31 + F.col("s"), F.lit(991)) / 1000.0).alias("lat"),
        F.col("q").cast("int").alias("area_px"), (F.col("x") / 1000.0).alias("peak_db"))


@query("candidate_counts")
def candidate_counts(spark, folder):
    structures = B.table(spark, folder, "supplier").select((50.0 + F.pmod("s_suppkey", F.lit(97)) / 97.0).alias("site_lon"), (25.0 + F.pmod(F.col("s_suppkey") * 7, F.lit(89)) / 89.0).alias("site_lat"))
    kept = S.thin_candidates(S.judge_candidates(_candidates(spark, folder), structures))
    water = _candidates(spark, folder).groupBy("product_id", "aoi_id").agg((F.count_if(F.col("area_px") > 5) / F.count("*")).alias("valid_water_fraction"))
    c = S.snapshot_counts(kept, water)
    return c.select("product_id", "aoi_id", F.round("valid_water_fraction", 5).alias("valid_water_fraction"), "raw_count", "candidate_count")


@query("footprint_overlap", POINTS + """, b AS (SELECT c_custkey, CAST(lon AS DOUBLE) AS x, CAST(lat AS DOUBLE) AS y FROM c)
 SELECT c_custkey, ROUND(GREATEST(0, LEAST(x + 30, 60) - GREATEST(x, -60)) * GREATEST(0, LEAST(y + 20, 40) - GREATEST(y, -40)) / (120.0 * 80.0) + 1e-9, 6) AS fraction FROM b""")
def footprint_overlap(spark, folder):
    """Share of a fixed area box that a footprint rectangle at each customer point covers."""
    c = B.customer_points(spark, folder)

    def box(w, s, e, n):
        return F.array(*[F.struct(a.alias("lon"), b.alias("lat")) for a, b in ((w, s), (e, s), (e, n), (w, n), (w, s))])
    x, y = F.col("lon"), F.col("lat")
    d = c.select("c_custkey", box(x, y, x + 30, y + 20).alias("scene"), box(F.lit(-60.0), F.lit(-40.0), F.lit(60.0), F.lit(40.0)).alias("area"))
    return d.select("c_custkey", F.round(overlap_fraction("scene", "area") + 1e-9, 6).alias("fraction"))
