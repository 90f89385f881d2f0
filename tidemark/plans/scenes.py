"""Scene catalogue coverage, comparability, pixel change and candidate counts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    CANDIDATE_MAX_PX, CANDIDATE_MIN_PX, DEDUPE_M, FIXED_STRUCTURE_M, MIN_WATER, NBR_DROP, PIXEL_AREA_M2, USABLE_CLASSES,
)
from ..functions.numbers import burn_ratio
from ..operators.spatial import near_any, thin_by_distance
from ..operators.timeline import with_previous

S1_KEYS = ["relative_orbit", "orbit_direction", "instrument_mode", "polarisation"]
SNAPSHOT_UNIT = "candidate vessels present in one radar snapshot (count)"


def scenes_for(scenes: DataFrame, scene_aoi: DataFrame, min_fraction: float = 0.0) -> DataFrame:
    j = scenes.join(scene_aoi, "product_id")
    return j.where(F.coalesce("intersection_fraction", F.lit(0.0)) >= min_fraction) if min_fraction > 0 else j


def acquisition_group() -> Column:
    return F.concat(F.lit("rel"), F.col("relative_orbit").cast("string"), F.lit("-"),
                    F.substring(F.coalesce("orbit_direction", F.lit("?")), 1, 3), F.lit("-"), F.col("instrument_mode"),
                    F.lit("-"), F.col("polarisation"))


def coverage_summary(scenes: DataFrame, scene_aoi: DataFrame, min_fraction: float = 0.9) -> DataFrame:
    """Per area and mission: scenes, usable scenes, gaps between usable days, catalogue delay, unknown overlaps."""
    k = ["aoi_id", "mission"]
    j = scenes_for(scenes, scene_aoi)
    usable = F.coalesce(F.col("intersection_fraction"), F.lit(0.0)) >= min_fraction
    # Whole seconds: the exact median then keeps few distinct values however many scenes there are.
    hours = (F.unix_timestamp("published_at") - F.unix_timestamp("acquisition_end")) / 3600
    base = j.groupBy(*k).agg(
        F.count("*").alias("n_scenes"), F.count_if(usable).alias("n_usable"),
        F.min("acquisition_start").alias("first_acquisition"), F.max("acquisition_start").alias("last_acquisition"),
        F.percentile(hours, 0.5).alias("median_latency_h"),
        F.count_if(F.col("intersection_fraction").isNull()).alias("n_fraction_unknown"),
        F.percentile(F.when(usable, F.col("cloud_cover")), 0.5).alias("cloud_cover_median"),
        F.array_join(F.array_sort(F.collect_set(F.when(usable, F.col("tile_id")))), ",").alias("tiles"))
    days = j.where(usable).select(*k, F.to_date("acquisition_start").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(*k).orderBy("day")))
    gaps = days.withColumn("gap", gap).groupBy(*k).agg(
        F.count("*").alias("n_usable_days"), F.percentile("gap", 0.5).alias("median_gap_days"),
        F.max("gap").alias("max_gap_days"))
    return base.join(gaps, k, "left").withColumn("n_usable_days", F.coalesce("n_usable_days", F.lit(0)))


def group_counts(scenes: DataFrame, scene_aoi: DataFrame, min_fraction: float = 0.9) -> DataFrame:
    return (scenes_for(scenes, scene_aoi, min_fraction).withColumn("comparable_group", acquisition_group())
            .groupBy("aoi_id", "comparable_group").agg(F.count("*").alias("n_scenes")))


def _low_fraction(side: str, limit: float) -> Column:
    fr = F.col(f"{side}.intersection_fraction")
    return F.when(fr.isNull() | (fr < limit), F.concat(
        F.col(f"{side}.product_id").cast("string"), F.lit(": AOI coverage "), F.coalesce(fr.cast("string"), F.lit("unknown")),
        F.lit(f" < {limit}")))


def comparable_pairs(pairs: DataFrame, keys: Sequence[str] = tuple(S1_KEYS), min_fraction: float = 0.9,
                     counts: bool = False) -> DataFrame:
    """pairs: struct columns a and b of two acquisitions. Adds reasons and valid (no reason left)."""
    differs = [F.when(~F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), F.concat(
        F.lit(f"{k} differs ("), F.coalesce(F.col(f"a.{k}").cast("string"), F.lit("none")), F.lit(" vs "),
        F.coalesce(F.col(f"b.{k}").cast("string"), F.lit("none")), F.lit(")"))) for k in keys]
    types = F.when(F.substring(F.coalesce("a.product_type", F.lit("")), 1, 7)
                   != F.substring(F.coalesce("b.product_type", F.lit("")), 1, 7), "product types differ")
    checks = differs + [_low_fraction("a", min_fraction), _low_fraction("b", min_fraction), types]
    if counts:
        checks += [F.when(F.col(f"{s}.candidate_count").isNull(), F.concat(
            F.col(f"{s}.product_id").cast("string"), F.lit(": insufficient valid water coverage"))) for s in ("a", "b")]
    d = pairs.withColumn("reasons", F.array_compact(F.array(*checks)))
    return d.withColumn("valid", F.size("reasons") == 0)


def consecutive_pairs(snapshots: DataFrame) -> DataFrame:
    """Each acquisition of an area with the one before it: what a before/after comparison asks for."""
    names = [c for c in snapshots.columns if c != "aoi_id"]
    d = with_previous(snapshots, ["aoi_id"], "acquisition_start", ["product_id"],
                      [c for c in names if c != "acquisition_start"], bucket_seconds=604_800, name="_prev")
    a = F.struct(*[F.col("_prev")[c].alias(c) for c in names])
    return d.where("_prev IS NOT NULL").select("aoi_id", F.struct(*names).alias("b"), a.alias("a"))


def snapshot_differences(counts: DataFrame, scenes: DataFrame, scene_aoi: DataFrame) -> DataFrame:
    """Count differences between consecutive snapshots of an area, given only where they are comparable."""
    cols = ["product_id", "product_type", *S1_KEYS]
    j = counts.join(scenes.select(*cols), "product_id").join(
        scene_aoi.select("product_id", "aoi_id", "intersection_fraction"), ["product_id", "aoi_id"], "left")
    c = comparable_pairs(consecutive_pairs(j), counts=True)
    return c.withColumn("difference", F.when(F.col("valid"), F.col("b.candidate_count") - F.col("a.candidate_count")))


# ------------------------------------------------------------------ pixels
def pixel_change(pixels: DataFrame, min_usable: float = 0.7, ratio: tuple = (0.8, 1.25), threshold: float = NBR_DROP,
                 min_ring: int = 200) -> DataFrame:
    """Before/after change at a site from a long pixel table.

    pixels: site_id, scene, role (pre/post), tile, row, col, b8a, b11, b12, scl, inside; one row per scene and
    pixel, one post scene per site. A comparison is refused with reasons when the grids differ, the site is
    clouded or not covered, or the surroundings changed brightness; cloud means unobservable, not undamaged.
    """
    usable = F.col("scl").isin(USABLE_CLASSES)
    inside = F.col("inside")
    nodata = (F.col("b8a") == 0) & (F.col("b11") == 0) & (F.col("b12") == 0)
    per_scene = pixels.groupBy("site_id", "scene", "role").agg(
        F.count_if(inside).alias("n_inside"), F.count_if(inside & usable).alias("n_usable"),
        F.count_if(inside & nodata).alias("n_nodata"), F.max("tile").alias("tile_hi"), F.min("tile").alias("tile_lo"),
        F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    share = F.coalesce(F.try_divide("n_usable", "n_inside"), F.lit(0.0))
    scene_reasons = F.array_compact(F.array(
        F.when((F.col("n_inside") == 0) | (F.col("n_nodata") > 0.01 * F.col("n_inside")), F.concat(
            "scene", F.lit(": facility not fully covered by valid pixels (non-overlapping footprint)"))),
        F.when(share < min_usable, F.concat("scene", F.lit(": only "), F.format_string("%.0f%%", share * 100), F.lit(
            " of facility usable — facility unobservable, not undamaged")))))
    grid = F.count_distinct("r0", "r1", "c0", "c1")
    site = per_scene.withColumn("_why", scene_reasons).groupBy("site_id").agg(
        F.array_sort(F.flatten(F.collect_list("_why"))).alias("_scene_reasons"),
        F.when((F.min("tile_lo") != F.max("tile_hi")) | (grid > 1),
               "scenes not on one grid — no co-registration attempted").alias("_grid"),
        F.when(F.count_if(F.col("role") == "pre") == 0, "no pre-event scene supplied").alias("_no_pre"))
    bands = pixels.withColumns({"usable": usable, "nbr": F.when(usable, burn_ratio(F.col("b8a"), F.col("b12")))})
    at = ["site_id", "row", "col"]
    post = bands.where("role = 'post'").select(*at, F.col("b8a").alias("q8"), F.col("b11").alias("q11"),
                                               F.col("usable").alias("qu"), F.col("inside").alias("qi"), F.col("nbr").alias("qn"))
    pre = bands.where("role = 'pre'")
    ring = pre.join(post, at).where(F.col("usable") & F.col("qu") & ~F.col("inside") & ~F.col("qi"))
    # Reflectance comes from 16-bit numbers, so the exact medians hold at most 65,536 distinct values.
    rad = ring.groupBy("site_id", "scene").agg(
        F.count("*").alias("n"), F.try_divide(F.percentile("q8", 0.5), F.percentile("b8a", 0.5)).alias("ratio8"),
        F.try_divide(F.percentile("q11", 0.5), F.percentile("b11", 0.5)).alias("ratio11"))
    pres = per_scene.where("role = 'pre'").select("site_id", "scene").join(rad, ["site_id", "scene"], "left")
    lo, hi = ratio
    off = ~F.coalesce(F.col("ratio8").between(lo, hi) & F.col("ratio11").between(lo, hi), F.lit(False))
    why = (F.when(F.coalesce("n", F.lit(0)) < min_ring, F.concat("scene", F.lit(
        ": too few clear surrounding pixels for radiometric comparison")))
        .when(off, F.concat("scene", F.lit(": surrounding-area median reflectance ratio outside limits"))))
    light = pres.groupBy("site_id").agg(F.array_sort(F.collect_list(why)).alias("_light"))
    before = pre.where("nbr IS NOT NULL").groupBy(*at).agg(F.percentile("nbr", 0.5).alias("pn"))
    drop = before.join(post.where("qi AND qn IS NOT NULL"), at).withColumn("dnbr", F.col("pn") - F.col("qn"))
    change = drop.groupBy("site_id").agg(F.count("*").alias("_evaluated"), F.count_if(F.col("dnbr") > threshold).alias("_cand"))
    out = site.join(light, "site_id", "left").join(change, "site_id", "left")
    first = F.concat(F.array_compact(F.array("_no_pre", "_grid")), F.col("_scene_reasons"))
    reasons = F.when(F.size(first) > 0, first).otherwise(F.coalesce("_light", F.array().cast("array<string>")))
    out = out.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)
    n = F.coalesce("_cand", F.lit(0))
    return out.select("site_id", "valid", "reasons",
                      F.when(F.col("valid"), F.coalesce("_evaluated", F.lit(0))).alias("evaluated_pixels"),
                      F.when(F.col("valid"), n).alias("candidate_pixels"),
                      F.when(F.col("valid"), n * PIXEL_AREA_M2).alias("candidate_area_m2"))


# ------------------------------------------------------------------ candidates
def judge_candidates(cands: DataFrame, structures: DataFrame) -> DataFrame:
    """Initial review status: size limits first, then the fixed-structure mask.

    cands: detection_id, product_id, aoi_id, lon, lat, area_px, peak_db; structures: site_lon, site_lat.
    """
    d = near_any(cands, "detection_id", structures, FIXED_STRUCTURE_M / 1000, "_fixed", cell_deg=0.005)
    return d.withColumn("review_status", F.when(F.col("area_px") < CANDIDATE_MIN_PX, "rejected_auto:too_small")
                        .when(F.col("area_px") > CANDIDATE_MAX_PX, "rejected_auto:too_large (structure/artefact?)")
                        .when(F.col("_fixed"), "masked:fixed_structure").otherwise("unreviewed")).drop("_fixed")


def thin_candidates(judged: DataFrame) -> DataFrame:
    """Per scene and area keep the brightest of unreviewed candidates closer than the dedupe distance."""
    return thin_by_distance(judged, ["product_id", "aoi_id"], "detection_id", F.col("peak_db"), DEDUPE_M / 1000,
                            F.col("review_status") == "unreviewed")


def snapshot_counts(kept: DataFrame, water: DataFrame, min_water: float = MIN_WATER) -> DataFrame:
    """Unreviewed candidates per snapshot; no count where too little water was visible."""
    k = ["product_id", "aoi_id"]
    n = kept.groupBy(*k).agg(F.count_if(F.col("review_status") == "unreviewed").alias("raw_count"))
    d = water.join(n, k, "left").withColumn("raw_count", F.coalesce("raw_count", F.lit(0)))
    ok = F.col("valid_water_fraction") >= min_water
    return d.withColumns({"candidate_count": F.when(ok, F.col("raw_count")), "comparable": ok, "unit": F.lit(SNAPSHOT_UNIT)})


def precision_report(reviewed: DataFrame, status: str, keys: Sequence[str] = ()) -> DataFrame:
    """Reviewed precision, null without reviews, experimental below fifty."""
    tp, fp = F.count_if(F.col(status) == "confirmed"), F.count_if(F.col(status) == "rejected")
    d = reviewed.groupBy(*keys).agg(tp.alias("confirmed"), fp.alias("rejected"))
    n = F.col("confirmed") + F.col("rejected")
    return d.withColumns({"reviewed": n, "precision": F.try_divide("confirmed", n), "status": F.when(
        n < 50, "EXPERIMENTAL until a reviewed sample exists").otherwise("reviewed sample available")})
