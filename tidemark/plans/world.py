"""Payloads for maps and charts: dense daily arrays, bands, mixes, tiles."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import change_class
from ..operators.timeline import densify_daily, quantile_band, rolling_mean, value_at_or_before


def baseline_means(obs: DataFrame, keys: Sequence[str], day: str, value: str, start: str, end: str, digits: int = 2,
                   scale: float = 1.0) -> DataFrame:
    inside = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return obs.where(inside).groupBy(*keys).agg(F.round(F.avg(value) / scale, digits).alias("baseline_mean"))


def dense_arrays(obs: DataFrame, keys: Sequence[str], day: str, value: str, first: str, last: str) -> DataFrame:
    """Per key one array with an element for every day of the common range; absent days are null.

    Arrays are as long as the calendar range, so a row stays small however many facts were aggregated.
    """
    keys = list(keys)
    grid = obs.select(*keys).distinct().withColumn(day, F.explode(F.sequence(
        F.lit(first).cast("date"), F.lit(last).cast("date"))))
    d = grid.join(obs.select(*keys, day, value), keys + [day], "left")
    return d.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def type_total(wide: DataFrame, types: Sequence[str], name: str = "total") -> DataFrame:
    """Sum over all types; null as soon as one of them is missing."""
    total = F.col(types[0])
    for t in types[1:]:
        total = total + F.col(t)
    return wide.withColumn(name, total)


def type_mix(long: DataFrame, keys: Sequence[str], kind: str, value: str) -> DataFrame:
    """Share of each type in the sum of a window; types without a positive sum are left out."""
    keys = list(keys)
    s = long.groupBy(*keys, kind).agg(F.sum(value).alias("volume")).where("volume > 0")
    t = s.groupBy(*keys).agg(F.sum("volume").alias("_t"))
    return s.join(t, keys).withColumn("share", F.col("volume") / F.col("_t")).drop("_t")


def stacked_totals(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Total per column of a stacked chart: the known parts, null only if none is known."""
    return long.groupBy(*keys).agg(F.sum(value).alias("total"))


def map_state(obs: DataFrame, baseline: DataFrame, day: str, min_obs: int = 4) -> DataFrame:
    """Latest 7-day mean per series (four reported days suffice) and its class against the baseline."""
    dense = rolling_mean(densify_daily(obs, ["series_id"], day), ["series_id"], day, "value", 7, min_obs, "mean_7d")
    last = dense.where("value IS NOT NULL").groupBy("series_id").agg(
        F.max(day).alias("last_day"), F.max_by("mean_7d", day).alias("mean_7d"))
    j = last.join(baseline, "series_id", "left")
    change = F.when(F.col("baseline_mean") > 0, F.col("mean_7d") / F.col("baseline_mean") - 1)
    return j.withColumn("change", change).withColumn("change_class", change_class(F.col("change")))


def line_payload(obs: DataFrame, day: str, digits: int = 5) -> DataFrame:
    """x/y arrays of a chart line per series as JSON."""
    pts = F.array_sort(F.collect_list(F.struct(F.col(day).cast("string").alias("x"), F.round("value", digits).alias("y"))))
    g = obs.groupBy("series_id").agg(pts.alias("p"))
    return g.select("series_id", F.to_json(F.struct(
        F.transform("p", lambda q: q["x"]).alias("x"), F.transform("p", lambda q: q["y"]).alias("y")),
        {"ignoreNullFields": "false"}).alias("payload"))


def band_with_chip(obs: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """7-day line's latest value against its fixed-window band; the chip says when it is far below."""
    dense = rolling_mean(densify_daily(obs, ["series_id"], day), ["series_id"], day, "value", 7, 6, "mean_7d")
    inside = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    band = quantile_band(dense.where(inside), ["series_id"], "mean_7d")
    last = dense.where("mean_7d IS NOT NULL").groupBy("series_id").agg(
        F.max(day).alias("last_day"), F.max_by("mean_7d", day).alias("mean_7d"))
    return last.join(band, "series_id", "left").withColumn(
        "chip", F.when(F.col("mean_7d") < F.col("band_low"), "Far below normal"))


def tiles(obs: DataFrame, wanted: Mapping[str, str], cutoff: str) -> DataFrame:
    """Latest value per wanted series beside its value at a reference date."""
    o = obs.where(F.col("series_id").isin(list(wanted)) & F.col("value").isNotNull())
    last = o.groupBy("series_id").agg(F.max("obs_end").alias("last_day"), F.max_by("value", "obs_end").alias("last_value"))
    ref = value_at_or_before(o, "series_id", "obs_end", "value", F.lit(cutoff).cast("date")).select(
        "series_id", F.col("obs_end").alias("ref_day"), F.col("value").alias("ref_value"))
    label = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    return last.join(ref, "series_id", "left").withColumn("label", F.try_element_at(label, F.col("series_id")))
