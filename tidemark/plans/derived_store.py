"""Derived series kept as versions: every row names the input versions it was made of, and only what changed is made again."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LITRES_PER_BARREL
from ..operators.timeline import asof_join, interval_mean
from ..operators.versioned import merge_observations

RATE_DAYS = 3                   # how old a reference rate may be
WINDOW = (3, 7)                 # crude days before a bulletin date that its cost is made of


@dataclass(frozen=True)
class WedgeInputs:
    """Which observations feed the cost wedge: crude in dollars, dollars per euro, and retail prices without tax per litre."""
    crude: str
    rate: str
    retail: Column

    def part(self, obs: DataFrame, which: str | Column) -> DataFrame:
        return obs.where("value IS NOT NULL").where(F.col("series_id") == which if isinstance(which, str) else which)


def affected_dates(changed: DataFrame, series: WedgeInputs) -> DataFrame:
    """Bulletin dates whose wedge can differ after versions ``changed``: through the crude window, through a rate that is the
    latest for up to three crude days, or by their own price. A rate's first version displaces an older one on the same days."""
    lo, hi = WINDOW

    def reach(which: str | Column, first: int, last: int) -> DataFrame:
        d = changed.where(F.col("series_id") == which if isinstance(which, str) else which)
        return d.select(F.explode(F.sequence(F.date_add("obs_start", first), F.date_add("obs_start", last))).alias("obs_start"))
    crude, rate, own = reach(series.crude, lo, hi), reach(series.rate, lo, hi + RATE_DAYS), reach(series.retail, 0, 0)
    return crude.unionByName(rate).unionByName(own).distinct()


def wedge_rows(obs: DataFrame, series: WedgeInputs, dates: DataFrame | None = None) -> DataFrame:
    """(series_id, obs_start, value, attrs) of the wedge from current observations; attrs lists the input version ids.

    With ``dates`` only those are made, from the crude days and rates they need: both are cut down by equality joins before
    anything is joined in time. A date without crude in its window gets a null value, as its retail price alone is known.
    """
    crude, rate = series.part(obs, series.crude), series.part(obs, series.rate)
    retail = obs.where(series.retail)
    if dates is not None:
        retail = retail.join(dates, "obs_start", "left_semi")
        lo, hi = WINDOW
        days = dates.select(F.explode(F.sequence(F.date_sub("obs_start", hi), F.date_sub("obs_start", lo))).alias("obs_start")).distinct()
        crude = crude.join(days, "obs_start", "left_semi")
        rate = rate.join(days.select(F.explode(F.sequence(F.date_sub("obs_start", RATE_DAYS), F.col("obs_start"))).alias("obs_start")).distinct(), "obs_start", "left_semi")
    one = F.lit(0).alias("all")
    crude = crude.select(one, "obs_start", F.col("value").alias("usd"), F.col("version_id").alias("crude_id"))
    rate = rate.select(one, F.col("obs_start").alias("rate_day"), F.col("value").alias("rate"), F.col("version_id").alias("rate_id"))
    euro = asof_join(crude, rate, "obs_start", "rate_day", ["all"], RATE_DAYS).select(
        "all", F.col("obs_start").alias("crude_day"), (F.col("usd") / F.col("rate")).alias("eur"), F.array("crude_id", "rate_id").alias("ids"))
    points = retail.select(one, "obs_start").distinct()
    cost = interval_mean(points, euro, ["all"], "obs_start", "crude_day", "eur", *WINDOW)
    # The window's few days name their inputs; collected per bulletin date, five pairs at most.
    used = euro.select(F.explode(F.sequence(F.date_add("crude_day", WINDOW[0]), F.date_add("crude_day", WINDOW[1]))).alias("obs_start"), F.explode("ids").alias("id"))
    used = used.join(points.select("obs_start"), "obs_start", "left_semi").groupBy("obs_start").agg(F.collect_set("id").alias("ids"))
    j = retail.join(cost.select("obs_start", (F.col("mean_value") / LITRES_PER_BARREL).alias("cost")), "obs_start").join(used, "obs_start", "left")
    ids = F.array_sort(F.array_union(F.coalesce("ids", F.array().cast("array<string>")), F.array("version_id")))
    return j.select(F.concat(F.lit("wedge."), F.col("series_id")).alias("series_id"), "obs_start", (F.col("value") - F.col("cost")).alias("value"), F.to_json(F.struct(ids.alias("inputs"))).alias("attrs"))


def refresh_wedge(derived: DataFrame, versions: DataFrame, series: WedgeInputs, since: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """Next version of the derived table, and counts, after input versions first seen at or after ``since``.

    Only dates that those versions reach are made again; a date whose value comes out the same gets no new version.
    """
    current = versions.where("is_current")
    dates = affected_dates(current.where(F.col("first_seen_at") >= since), series)
    return merge_observations(derived, wedge_rows(current, series, dates), at)
