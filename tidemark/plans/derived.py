"""Derived series: euro crude, per-litre cost, taxes, wedges, spreads, shares, household costs, real prices."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AGGREGATE_CODES, CPI_1998_TO_2010, GALLONS_PER_BARREL, LITRES_PER_BARREL, TANK_LITRES, VAT_RATE
from ..operators.timeline import asof_join, chain_index, deflate, interval_mean


def euro_crude(crude: DataFrame, rates: DataFrame, by: Sequence[str] = ("pair",), tolerance_days: int = 3) -> DataFrame:
    """USD crude divided by the latest rate at most three days old; days without one are dropped.

    crude: pair, obs_start, value, version_id; rates: pair, fx_date, fx, fx_version_id.
    """
    j = asof_join(crude, rates, "obs_start", "fx_date", by, tolerance_days)
    return j.withColumns({"eur_bbl": F.col("value") / F.col("fx"),
                          "eur_litre": F.col("value") / F.col("fx") / F.lit(LITRES_PER_BARREL),
                          "inputs": F.array("version_id", "fx_version_id")})


def aligned_crude(points: DataFrame, crude_eur: DataFrame, by: Sequence[str] = ("pair",)) -> DataFrame:
    """Mean euro crude per litre over the days D-7..D-3 before each bulletin date D."""
    facts = crude_eur.select(*by, F.col("obs_start").alias("fact_day"), "eur_bbl")
    m = interval_mean(points, facts, by, "obs_start", "fact_day", "eur_bbl", 3, 7)
    return m.withColumn("crude_litre", F.col("mean_value") / F.lit(LITRES_PER_BARREL)).drop("mean_value")


def same_day(a: DataFrame, b: DataFrame, keys: Sequence[str], combine: Column, name: str) -> DataFrame:
    """Inner join on keys and date; ``combine`` sees value_a and value_b."""
    left = a.select(*keys, "obs_start", F.col("value").alias("value_a"), F.col("version_id").alias("id_a"))
    right = b.select(*keys, "obs_start", F.col("value").alias("value_b"), F.col("version_id").alias("id_b"))
    j = left.join(right, list(keys) + ["obs_start"]).where("value_a IS NOT NULL AND value_b IS NOT NULL")
    return j.select(*keys, "obs_start", combine.alias(name), F.array("id_a", "id_b").alias("inputs"))


def crack_spread(product_usd_gal: DataFrame, crude_usd_bbl: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return same_day(product_usd_gal, crude_usd_bbl, keys,
                    F.round(F.col("value_a") * GALLONS_PER_BARREL - F.col("value_b"), 4), "value")


def tax_split(with_tax: DataFrame, without_tax: DataFrame, keys: Sequence[str], vat_rate: float = VAT_RATE) -> DataFrame:
    """Taxes per unit split into VAT (part of the gross price) and everything else."""
    vat = F.col("value_a") * vat_rate / (1 + vat_rate)
    both = same_day(with_tax, without_tax, keys, F.struct(
        (F.col("value_a") - F.col("value_b")).alias("taxes"), vat.alias("vat"),
        ((F.col("value_a") - F.col("value_b")) - vat).alias("other_taxes")), "parts")
    return both.select(*keys, "obs_start", "parts.*", "inputs")


def tax_table(split: DataFrame, keys: Sequence[str], base_start: str, base_end: str, tank: float = TANK_LITRES) -> DataFrame:
    """Latest VAT against the base-period mean, per unit and per tank."""
    in_base = F.col("obs_start").between(F.lit(base_start).cast("date"), F.lit(base_end).cast("date"))
    a = split.groupBy(*keys).agg(
        F.max("obs_start").alias("latest_date"), F.max_by("vat", "obs_start").alias("vat_now"),
        F.avg(F.when(in_base, F.col("vat"))).alias("vat_base"),
        F.max_by("other_taxes", "obs_start").alias("other_now"),
        F.avg(F.when(in_base, F.col("other_taxes"))).alias("other_base"))
    return a.withColumns({"vat_extra": F.col("vat_now") - F.col("vat_base"),
                          "vat_extra_per_tank": (F.col("vat_now") - F.col("vat_base")) * tank})


def cost_wedge(without_tax: DataFrame, aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pretax retail minus prior-week crude; null where no crude day fell into the window."""
    j = without_tax.join(aligned.select(*keys, "obs_start", "crude_litre", "n_days"), list(keys) + ["obs_start"])
    return j.withColumn("wedge", F.col("value") - F.col("crude_litre"))


def group_share(df: DataFrame, period: Sequence[str], code: str, value: str, members: list, total: DataFrame) -> DataFrame:
    """Members' sum as percent of the reported total; absent members count as nothing in the sum."""
    part = df.where(F.col(code).isin(members)).groupBy(*period).agg(F.sum(value).alias("_part"))
    t = total.select(*period, F.col(value).alias("_total"))
    return t.join(part, list(period), "left").select(
        *period, (F.coalesce("_part", F.lit(0.0)) / F.col("_total") * 100).alias("share_pct")).where("share_pct IS NOT NULL")


def top_partners(df: DataFrame, code: str, value: str, n: int = 10, exclude: Sequence[str] = tuple(AGGREGATE_CODES)) -> DataFrame:
    """The n largest partners with their share of all partners; aggregate codes never rank."""
    sums = df.where(~F.col(code).isin(list(exclude))).groupBy(code).agg(F.sum(value).alias("volume"))
    total = sums.agg(F.sum("volume")).scalar()
    top = sums.orderBy(F.col("volume").desc(), code).limit(n)
    return top.withColumn("share_pct", F.col("volume") / total * 100)


def balanced_sample(df: DataFrame, entity: str, period: str, value: str, periods: list) -> DataFrame:
    """Entities with a flag: do they report a value in every asked period? (Distinct periods, pre-aggregated.)"""
    asked = df.where(F.col(period).isin(periods))
    have = asked.groupBy(entity, period).agg(F.max(F.col(value).isNotNull()).alias("_ok"))
    return have.groupBy(entity).agg(F.count_if("_ok").alias("n_periods")).withColumn(
        "included", F.col("n_periods") == len(set(periods)))


def restrict_to_balanced(df: DataFrame, entity: str, period: str, value: str, periods: list) -> DataFrame:
    ok = balanced_sample(df, entity, period, value, periods).where("included").select(entity)
    return df.where(F.col(period).isin(periods)).join(ok, entity, "left_semi")


def sum_if_all_present(df: DataFrame, keys: Sequence[str], member: str, value: str, members: list) -> DataFrame:
    """Sum over members, null unless every one of them has a value."""
    d = df.where(F.col(member).isin(members))
    n = F.count_distinct(F.when(F.col(value).isNotNull(), F.col(member)))
    return d.groupBy(*keys).agg(n.alias("n_present"), F.when(n == len(members), F.sum(value)).alias("total"))


def household_costs(index: DataFrame, code: str, day: str, value: str, spend: dict, base_start: str, base_end: str) -> DataFrame:
    """Base-period spending scaled by each energy type's own price index."""
    in_base = F.col(day).between(F.lit(base_start).cast("date"), F.lit(base_end).cast("date"))
    s = F
    for k, v in spend.items():
        s = s.when(F.col(code) == k, float(v))
    a = index.where(F.col(code).isin(list(spend)) & F.col(value).isNotNull()).groupBy(code).agg(
        F.max(day).alias("latest"), F.max_by(value, day).alias("_last"), F.avg(F.when(in_base, F.col(value))).alias("_base"))
    a = a.withColumn("spend_base", s.otherwise(None))
    return a.select(code, "latest", "spend_base", (F.col("_last") / F.col("_base") * 100).alias("index_100"),
                    (F.col("spend_base") * F.col("_last") / F.col("_base")).alias("spend_now"),
                    (F.col("spend_base") * F.col("_last") / F.col("_base") - F.col("spend_base")).alias("difference"))


def real_prices(df: DataFrame, year: str, rate: str, columns: Sequence[str], base_year: int, start_year: int = 2010,
                bridge: float = CPI_1998_TO_2010, by: Sequence[str] = ()) -> DataFrame:
    """Chained price index and every column in base-year money."""
    return deflate(chain_index(df, year, rate, start_year, bridge, by), year, columns, base_year, by)


def component_shares(df: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    return df.withColumns({f"share_{p}": F.col(p) / F.col(total) * 100 for p in parts})


def residual_share(df: DataFrame, share: str, name: str = "share_rest") -> DataFrame:
    """What is left beside the one reported share, for years that report no other."""
    return df.withColumn(name, 100.0 - F.col(share))


def real_change(long: DataFrame, keys: Sequence[str], year: str, value: str, from_year: int, to_year: int) -> DataFrame:
    a = long.groupBy(*keys).agg(
        F.max(F.when(F.col(year) == from_year, F.col(value))).alias("_a"),
        F.max(F.when(F.col(year) == to_year, F.col(value))).alias("_b"))
    return a.select(*keys, ((F.col("_b") / F.col("_a") - 1) * 100).alias("change_pct"))


def panel_daily_stats(readings: DataFrame, day: Column, city: str, fuels: Sequence[str], today: Column) -> DataFrame:
    """Daily mean, median and count per fuel, for the panel and per city, from completed days only.

    readings: one row per station and fetch with a column per fuel and ``status``.
    Open readings of a city and day are unbounded, so mean and count pre-aggregate; the exact median keeps
    a value-to-count map per group rather than the rows.
    """
    d = readings.where(F.col("status") == "open").withColumn("day", day).where(F.col("day") < today)
    long = d.unpivot(["day", city], list(fuels), "fuel", "price").where("price IS NOT NULL")
    g = long.groupingSets([["day", "fuel"], ["day", "fuel", city]], "day", "fuel", city).agg(
        F.avg("price").alias("mean_price"), F.percentile("price", 0.5).alias("median_price"),
        F.count("price").alias("n_readings"), F.grouping(city).alias("is_panel"))
    return g


def latest_snapshot(readings: DataFrame, at: str, fuels: Sequence[str]) -> DataFrame:
    """Mean of the open readings at the newest fetch time."""
    newest = readings.agg(F.max(at).alias(at))
    return readings.where("status = 'open'").join(newest, at, "left_semi").groupBy(at).agg(
        F.count("*").alias("n_open"), *[F.avg(f).alias(f) for f in fuels])


def previous_year(df: DataFrame, keys: Sequence[str], day: str, value: str, name: str) -> DataFrame:
    """Value one calendar year earlier; the 29th of February looks at the 28th."""
    ly = df.select(*keys, F.col(day).alias("_ly"), F.col(value).alias(name))
    return df.withColumn("_ly", F.add_months(day, -12)).join(ly, list(keys) + ["_ly"], "left").drop("_ly")
