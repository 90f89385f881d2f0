"""Time-series operators.

Two shapes occur and are treated differently:

* *Daily series*: at most one row per key and calendar day, so a key's whole history is
  bounded by the calendar (about 37,000 rows a century) and a window over it is safe.
  Facts are aggregated to that grain before the shuffle.
* *Timestamped rows*: nothing bounds a key. ``with_previous`` and ``sessionize`` cut each key
  into time buckets and stitch the bucket edges, so one hot key spreads over many tasks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ------------------------------------------------------------------ joins in time
def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str],
              tolerance_days: int, how: str = "inner") -> DataFrame:
    """Latest right row on or before the left date, at most ``tolerance_days`` old (inclusive).

    The right side holds one row per ``by`` and date. Each of its rows is repeated for the days
    it is the latest one (at most tolerance + 1), which turns the as-of join into an equality
    join: the left side is neither sorted nor windowed and may be skewed.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(right_on)
    until = F.least(F.date_sub(F.lead(right_on).over(w), 1), F.date_add(right_on, tolerance_days))
    valid = right.withColumn("_until", until).withColumn(
        "_day", F.explode(F.sequence(F.col(right_on), F.col("_until")))).drop("_until")
    return (left.withColumn("_day", F.col(left_on))
            .join(valid, by + ["_day"], how).drop("_day"))


def value_at_or_before(series: DataFrame, key: str, day: str, value: str, cutoff: Column) -> DataFrame:
    """Per key the last non-missing value dated on or before the cutoff."""
    ok = F.col(value).isNotNull() & (F.col(day) <= cutoff)
    return (series.where(ok).groupBy(key)
            .agg(F.max(day).alias(day), F.max_by(value, day).alias(value)))


def interval_mean(points: DataFrame, facts: DataFrame, by: Sequence[str], point_day: str, fact_day: str, value: str,
                  lo_days: int, hi_days: int, inputs: str | None = None) -> DataFrame:
    """For each point the mean of facts dated point - hi_days .. point - lo_days, and how many.

    Facts are summed per day first; each daily sum then names the point days it belongs to,
    so the range condition becomes an equality join. Points without facts keep null and 0.
    """
    by = list(by)
    aggs = [F.sum(value).alias("_s"), F.count(value).alias("_c")]
    if inputs:
        aggs.append(F.collect_list(inputs).alias("_i"))
    daily = facts.where(F.col(value).isNotNull()).groupBy(*by, fact_day).agg(*aggs)
    placed = daily.withColumn(point_day, F.explode(F.sequence(
        F.date_add(fact_day, lo_days), F.date_add(fact_day, hi_days))))
    total = [F.sum("_s").alias("_s"), F.sum("_c").alias("n_days")]
    if inputs:
        total.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_i")))).alias("inputs"))
    # Only days that are asked for survive, before the sums are shuffled.
    wanted = points.select(*by, point_day).distinct()
    sums = placed.join(wanted, by + [point_day], "left_semi").groupBy(*by, point_day).agg(*total)
    out = points.join(sums, by + [point_day], "left")
    return out.withColumn("mean_value", F.col("_s") / F.col("n_days")).withColumn(
        "n_days", F.coalesce("n_days", F.lit(0))).drop("_s")


def densify_daily(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """A row for every day between a key's first and last day; absent days carry nulls, never zeros."""
    keys = list(keys)
    spine = (df.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
             .select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(day)))
    return spine.join(df, keys + [day], "left")


# ------------------------------------------------------------------ windows over daily series
def rolling_mean(dense: DataFrame, keys: Sequence[str], day: str, value: str, days: int = 7, min_obs: int = 6,
                 name: str = "rolling_mean") -> DataFrame:
    """Mean of the last ``days`` rows of a dense series; null below ``min_obs`` observed days."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-(days - 1), 0)
    n = F.count(value).over(w)
    return dense.withColumns({
        name: F.when(n >= min_obs, F.avg(value).over(w)), name + "_n": n})


def log_returns(df: DataFrame, keys: Sequence[str], day: str, value: str, max_gap_days: int) -> DataFrame:
    """Log return to the previous positive observation; a gap longer than allowed breaks the chain."""
    w = Window.partitionBy(*keys).orderBy(day)
    prev, prev_day = F.lag(value).over(w), F.lag(day).over(w)
    return df.where(F.col(value) > 0).withColumns({
        "previous_value": prev, "previous_date": prev_day,
        "ret": F.when(F.datediff(day, prev_day) <= max_gap_days, F.ln(F.col(value) / prev)),
    })


def first_differences(df: DataFrame, keys: Sequence[str], day: str, value: str, max_gap_days: int | None = None,
                      name: str = "change") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(day)
    diff = F.col(value) - F.lag(value).over(w)
    if max_gap_days is not None:
        diff = F.when(F.datediff(day, F.lag(day).over(w)) <= max_gap_days, diff)
    return df.where(F.col(value).isNotNull()).withColumns({
        "previous_value": F.lag(value).over(w), "previous_date": F.lag(day).over(w), name: diff})


def last_rows(df: DataFrame, keys: Sequence[str], day: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(day).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in a total order, by partial aggregation: nothing is sorted per key."""
    keys = list(keys)
    names = [c for c in df.columns if c not in keys]
    desc = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*names), desc).alias("_r"))
            .select(*keys, *[F.col("_r")[n].alias(n) for n in names]))


def quantile_band(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = (0.05, 0.95),
                  min_points: int = 20) -> DataFrame:
    """Low and high quantile and median per key; null when fewer than ``min_points`` values exist."""
    q = F.percentile(value, F.array(*[F.lit(float(p)) for p in (probs[0], 0.5, probs[1])]))
    out = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n_points"), q.alias("_q"))
    enough = F.col("n_points") >= min_points
    return out.select(*keys, "n_points", F.when(enough, F.col("_q")[0]).alias("band_low"),
                      F.when(enough, F.col("_q")[1]).alias("band_median"),
                      F.when(enough, F.col("_q")[2]).alias("band_high"))


def seasonal_baseline(df: DataFrame, key: str, day: str, value: str, targets: DataFrame, years: int = 5,
                      half_width: int = 1) -> DataFrame:
    """For target rows: earlier values of the same ISO weeks (mod 52) in the previous ISO years.

    Each target names the few (year, week) cells it may look at, so history is reached by equality.
    """
    iso_year, iso_week = F.extract(F.lit("YEAROFWEEK"), F.col(day)), F.weekofyear(day)
    history = df.select(key, iso_year.alias("_y"), iso_week.alias("_w"), F.col(day).alias("_hd"),
                        *[F.col(c).alias("_h_" + c) for c in (value, "value") if c in df.columns])
    cells = (targets.select(key, day, iso_year.alias("_ty"), iso_week.alias("_tw"))
             .withColumn("_k", F.explode(F.sequence(F.lit(-half_width), F.lit(half_width))))
             .withColumn("_w", F.pmod(F.col("_tw") - 1 + F.col("_k"), F.lit(52)) + 1)
             .withColumn("_y", F.explode(F.sequence(F.col("_ty") - years, F.col("_ty") - 1)))
             .select(key, day, "_y", "_w").distinct())
    found = cells.join(history, [key, "_y", "_w"]).where(F.col("_hd") < F.col(day))
    return found.groupBy(key, day).agg(
        F.collect_list("_h_" + value).alias("baseline"), F.percentile("_h_value", 0.5).alias("seasonal_level_median"))


def chain_index(df: DataFrame, year: str, rate: str, start_year: int, bridge: float | None = None,
                by: Sequence[str] = ()) -> DataFrame:
    """Index 1.0 in the first year >= start, times (1 + rate) after it; earlier years sit below by the bridge."""
    keys = list(by) or [F.lit(0)]
    whole = Window.partitionBy(*keys)
    first = F.min(F.when(F.col(year) >= start_year, F.col(year))).over(whole)
    running = whole.orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    growth = F.product(F.when(F.col(year) > F.col("_first"), 1 + F.col(rate)).otherwise(1.0)).over(running)
    early = F.lit(1.0 / bridge) if bridge else F.lit(None).cast("double")
    return (df.withColumn("_first", first)
            .withColumn("price_index", F.when(F.col(year) < F.col("_first"), early).otherwise(growth)).drop("_first"))


def deflate(df: DataFrame, year: str, columns: Sequence[str], base_year: int, by: Sequence[str] = ()) -> DataFrame:
    """Each column in money of the base year, as real_<column>."""
    keys = list(by) or [F.lit(0)]
    base = F.max(F.when(F.col(year) == base_year, F.col("price_index"))).over(Window.partitionBy(*keys))
    return df.withColumns({"real_" + c: F.col(c) * (base / F.col("price_index")) for c in columns})


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


# ------------------------------------------------------------------ timestamped rows, any key size
def _bucket(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], carry: Sequence[str] = (),
                  bucket_seconds: int = 86_400, name: str = "prev") -> DataFrame:
    """Previous row of the key in (ts, tie) order as a struct, without one task per key.

    ``lag`` runs inside (key, time bucket); the first row of a bucket takes the last row of the
    key's previous non-empty bucket from a table with one row per bucket.
    """
    keys = list(keys)
    here = F.struct(F.col(ts), *[F.col(c) for c in carry])
    rank = F.struct(F.col(ts), *[F.col(c) for c in tie])
    cut = df.withColumn("_bucket", _bucket(ts, bucket_seconds))
    local = Window.partitionBy(*keys, "_bucket").orderBy(ts, *tie)
    edges = cut.groupBy(*keys, "_bucket").agg(F.max_by(here, rank).alias("_end"))
    edges = edges.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_end")
    out = cut.withColumn("_local", F.lag(here).over(local)).join(edges, keys + ["_bucket"])
    return out.withColumn(name, F.coalesce("_local", "_before")).drop("_local", "_before")


def running_count(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], flag: str, name: str) -> DataFrame:
    """Running count of a boolean per key over rows that carry ``_bucket`` from with_previous."""
    keys = list(keys)
    local = Window.partitionBy(*keys, "_bucket").orderBy(ts, *tie).rowsBetween(Window.unboundedPreceding, 0)
    per_bucket = df.groupBy(*keys, "_bucket").agg(F.count_if(flag).alias("_c"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_base", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).drop("_c")
    return (df.withColumn("_n", F.sum(F.col(flag).cast("long")).over(local)).join(per_bucket, keys + ["_bucket"])
            .withColumn(name, F.col("_n") + F.col("_base")).drop("_n", "_base"))


def sessionize(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, tie: Sequence[str],
               bucket_seconds: int = 86_400) -> DataFrame:
    """Number the key's sessions from 1; a gap of exactly ``gap_seconds`` keeps a session open."""
    d = with_previous(df, keys, ts, tie, bucket_seconds=bucket_seconds, name="_prev")
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_prev")[ts].cast("timestamp"))
    d = d.withColumn("_new", F.coalesce(gap > gap_seconds * 1_000_000, F.lit(True)))
    return running_count(d, keys, ts, tie, "_new", "session_no").drop("_prev", "_new", "_bucket")
