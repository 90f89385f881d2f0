"""Derived series, aggregates, shares, indices and payloads."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators.timeline import densify_daily, latest_per_key, quantile_band, rolling_mean, value_at_or_before
from ..plans import derived, world
from .base import DAILY_COUNT, DAILY_CRUDE, DAILY_PRICE, WEEKLY_PRICE, query


def _weekly_tax(spark, folder, taxed: bool):
    li = B.table(spark, folder, "lineitem")
    gross = F.col("l_extendedprice") * (1 + F.col("l_tax")) if taxed else F.col("l_extendedprice")
    g = li.groupBy(F.concat(F.lit("lineitem."), F.col("l_returnflag")).alias("series_id"),
                   F.to_date(F.date_trunc("week", "l_shipdate")).alias("obs_start")).agg(
        F.sum(F.round(gross * 100).cast("bigint")).alias("c"), F.count("*").alias("n"))
    return g.select("series_id", "obs_start", (F.col("c").cast("double") / 100.0 / F.col("n")).alias("value"),
                    F.concat_ws("@", "series_id", F.col("obs_start").cast("string")).alias("version_id"))


@query("same_date_spread", f"""WITH s AS ({WEEKLY_PRICE}) SELECT CAST(a.obs_start AS VARCHAR) AS obs_start,
 ROUND(a.value * 42 - b.value, 4) AS value FROM s a JOIN s b USING (obs_start) WHERE a.series_id = 'lineitem.A' AND b.series_id = 'lineitem.R'""")
def same_date_spread(spark, folder):
    w = B.weekly_price(spark, folder)
    c = derived.crack_spread(w.where("series_id = 'lineitem.A'"), w.where("series_id = 'lineitem.R'"))
    return c.select(F.col("obs_start").cast("string").alias("obs_start"), "value")


TAX = """WITH g AS (SELECT 'lineitem.' || l_returnflag AS series_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS obs_start,
   CAST(SUM(CAST(ROUND(l_extendedprice * (1 + l_tax) * 100) AS BIGINT)) AS DOUBLE) / 100.0 / COUNT(*) AS w,
   CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / COUNT(*) AS wo FROM lineitem GROUP BY 1, 2),
 t AS (SELECT *, w * 0.19 / 1.19 AS vat FROM g)"""


@query("tax_split", TAX + """ SELECT series_id, CAST(obs_start AS VARCHAR) AS obs_start, ROUND(w - wo, 5) AS taxes, ROUND(vat, 5) AS vat,
 ROUND(w - wo - vat, 5) AS other_taxes FROM t""")
def tax_split(spark, folder):
    t = derived.tax_split(_weekly_tax(spark, folder, True), _weekly_tax(spark, folder, False), ["series_id"])
    return t.select("series_id", F.col("obs_start").cast("string").alias("obs_start"),
                    *[F.round(c, 5).alias(c) for c in ("taxes", "vat", "other_taxes")])


@query("tax_per_tank", TAX + """ SELECT series_id, CAST(MAX(obs_start) AS VARCHAR) AS latest_date, ROUND(arg_max(vat, obs_start), 5) AS vat_now,
 ROUND(AVG(vat) FILTER (WHERE obs_start BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'), 5) AS vat_base,
 ROUND((arg_max(vat, obs_start) - AVG(vat) FILTER (WHERE obs_start BETWEEN DATE '1998-01-01' AND DATE '1998-12-31')) * 50, 4) AS vat_extra_per_tank
 FROM t GROUP BY series_id""")
def tax_per_tank(spark, folder):
    t = derived.tax_split(_weekly_tax(spark, folder, True), _weekly_tax(spark, folder, False), ["series_id"])
    x = derived.tax_table(t, ["series_id"], "1998-01-01", "1998-12-31")
    return x.select("series_id", F.col("latest_date").cast("string").alias("latest_date"), F.round("vat_now", 5).alias("vat_now"),
                    F.round("vat_base", 5).alias("vat_base"), F.round("vat_extra_per_tank", 4).alias("vat_extra_per_tank"))


FUELS = ["view", "signup", "click", "purchase"]


def _readings(spark, folder):
    p = B.panel(spark, folder)
    return p.select("station_id", "city", "fetched_at", F.when(F.col("fuel") == "error", "closed").otherwise("open").alias("status"),
                    *[F.when(F.col("fuel") == f, F.col("price")).alias(f) for f in FUELS])


@query("panel_daily_stats", """WITH r AS (SELECT CAST(ts + INTERVAL 1 HOUR AS DATE) AS day, 'city' || (user_id % 10) AS city, event_type AS fuel, value AS price
   FROM events WHERE event_type <> 'error'), d AS (SELECT * FROM r WHERE day < DATE '2024-01-30' AND price IS NOT NULL)
 SELECT CAST(day AS VARCHAR) AS day, fuel, COALESCE(city, 'panel') AS city, ROUND(AVG(price) + 1e-9, 4) AS mean_price, ROUND(MEDIAN(price), 4) AS median_price,
 COUNT(price) AS n_readings FROM d GROUP BY GROUPING SETS ((day, fuel), (day, fuel, city))""")
def panel_daily_stats(spark, folder):
    from ..functions.dates import local_day
    d = derived.panel_daily_stats(_readings(spark, folder), local_day(F.col("fetched_at")), "city", FUELS,
                                  F.lit("2024-01-30").cast("date"))
    return d.select(F.col("day").cast("string").alias("day"), "fuel", F.when(F.col("is_panel") == 1, "panel").otherwise(
        F.col("city")).alias("city"), F.round(F.col("mean_price") + 1e-9, 4).alias("mean_price"), F.round("median_price", 4).alias("median_price"),
        "n_readings")


@query("latest_panel_reading", """WITH r AS (SELECT date_trunc('hour', ts) AS t, event_type, value FROM events)
 SELECT COUNT(*) AS n_open, ROUND(AVG(value) FILTER (WHERE event_type = 'view'), 4) AS view, ROUND(AVG(value) FILTER (WHERE event_type = 'click'), 4) AS click
 FROM r WHERE event_type <> 'error' AND t = (SELECT MAX(t) FROM r) GROUP BY t""")
def latest_panel_reading(spark, folder):
    r = _readings(spark, folder).withColumn("fetched_at", F.date_trunc("hour", "fetched_at"))
    s = derived.latest_snapshot(r, "fetched_at", FUELS)
    return s.select("n_open", F.round("view", 4).alias("view"), F.round("click", 4).alias("click"))


@query("latest_per_key", """SELECT o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_totalprice FROM orders
 QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key_query(spark, folder):
    o = B.table(spark, folder, "orders")
    r = latest_per_key(o.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"],
                       [F.col("o_orderdate"), F.col("o_orderkey")])
    return r.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"), "o_totalprice")


@query("value_at_or_before", f"""WITH s AS ({DAILY_PRICE}) SELECT series_id, CAST(MAX(obs_start) AS VARCHAR) AS obs_start, ROUND(arg_max(value, obs_start) + 1e-9, 4) AS value
 FROM s WHERE obs_start <= DATE '1999-09-09' GROUP BY series_id""")
def value_at_or_before_query(spark, folder):
    v = value_at_or_before(B.daily_price(spark, folder), "series_id", "obs_start", "value", F.lit("1999-09-09").cast("date"))
    return v.select("series_id", F.col("obs_start").cast("string").alias("obs_start"), F.round(F.col("value") + 1e-9, 4).alias("value"))


def _nation_lines(spark, folder):
    li = B.table(spark, folder, "lineitem").select("l_suppkey", "l_extendedprice", "l_shipdate")
    su = B.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    na = B.table(spark, folder, "nation").select("n_nationkey", "n_name")
    # Summed per supplier before any join: the fact table is shuffled once, already reduced.
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    per = li.groupBy("l_suppkey", month.alias("month")).agg(F.sum(B.cents("l_extendedprice")).alias("c"))
    return per.join(su, "l_suppkey").join(na, "n_nationkey")


NATION = """WITH x AS (SELECT n_name, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS c
   FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2)"""


@query("supplier_shares_top10", NATION + """ SELECT n_name, ROUND(CAST(SUM(c) AS DOUBLE) / 100, 2) AS volume,
 ROUND(CAST(SUM(c) AS DOUBLE) / (SELECT CAST(SUM(c) AS DOUBLE) FROM x WHERE n_name <> 'NATION_0') * 100, 5) AS share_pct
 FROM x WHERE n_name <> 'NATION_0' GROUP BY 1 ORDER BY SUM(c) DESC, n_name LIMIT 10""")
def supplier_shares_top10(spark, folder):
    x = _nation_lines(spark, folder)
    t = derived.top_partners(x, "n_name", "c", 10, ["NATION_0"])
    return t.select("n_name", F.round(F.col("volume").cast("double") / 100, 2).alias("volume"), F.round("share_pct", 5).alias("share_pct"))


@query("group_share_series", NATION + """ SELECT CAST(month AS VARCHAR) AS month, ROUND(CAST(SUM(CASE WHEN n_name IN ('NATION_1', 'NATION_3', 'NATION_7') THEN c ELSE 0 END) AS DOUBLE)
 / CAST(SUM(c) AS DOUBLE) * 100, 5) AS share_pct FROM x GROUP BY 1""")
def group_share_series(spark, folder):
    x = _nation_lines(spark, folder).groupBy("n_name", "month").agg(F.sum("c").cast("double").alias("c"))
    total = x.groupBy("month").agg(F.sum("c").alias("c"))
    s = derived.group_share(x, ["month"], "n_name", "c", ["NATION_1", "NATION_3", "NATION_7"], total)
    return s.select(F.col("month").cast("string").alias("month"), F.round("share_pct", 5).alias("share_pct"))


@query("balanced_sample", """WITH x AS (SELECT o_custkey, year(o_orderdate) AS y, o_totalprice FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2000)
 SELECT o_custkey, COUNT(DISTINCT y) FILTER (WHERE o_totalprice IS NOT NULL) AS n_periods,
 CAST(COUNT(DISTINCT y) FILTER (WHERE o_totalprice IS NOT NULL) = 6 AS INTEGER) AS included FROM x GROUP BY 1""")
def balanced_sample(spark, folder):
    o = B.table(spark, folder, "orders").withColumn("y", F.year("o_orderdate"))
    b = derived.balanced_sample(o, "o_custkey", "y", "o_totalprice", list(range(1995, 2001)))
    return b.select("o_custkey", "n_periods", F.col("included").cast("int").alias("included"))


USER_DAY = """WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, SUM(CAST(ROUND(value * 100) AS BIGINT)) AS c FROM events GROUP BY 1, 2, 3)"""


def _user_day(spark, folder):
    e = B.table(spark, folder, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.sum(B.cents("value")).alias("c"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("sum_if_all_present", USER_DAY + """ SELECT user_id, CAST(day AS VARCHAR) AS day, COUNT(DISTINCT event_type) FILTER (WHERE c IS NOT NULL) AS n_present,
 CASE WHEN COUNT(DISTINCT event_type) FILTER (WHERE c IS NOT NULL) = 5 THEN CAST(SUM(c) AS BIGINT) END AS total FROM x WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY 1, 2""")
def sum_if_all_present(spark, folder):
    s = derived.sum_if_all_present(_user_day(spark, folder), ["user_id", "day"], "event_type", "c", EVENT_TYPES)
    return s.select("user_id", F.col("day").cast("string").alias("day"), "n_present", "total")


@query("null_propagating_total", USER_DAY + """ SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(SUM(c) FILTER (WHERE event_type = 'click') + SUM(c) FILTER (WHERE event_type = 'error') + SUM(c) FILTER (WHERE event_type = 'purchase') + SUM(c) FILTER (WHERE event_type = 'signup') + SUM(c) FILTER (WHERE event_type = 'view') AS BIGINT) AS total FROM x GROUP BY 1, 2""")
def null_propagating_total(spark, folder):
    wide = _user_day(spark, folder).groupBy("user_id", "day").pivot("event_type", EVENT_TYPES).agg(F.sum("c"))
    return world.type_total(wide, EVENT_TYPES).select("user_id", F.col("day").cast("string").alias("day"), "total")


@query("type_mix", USER_DAY + """, s AS (SELECT user_id, event_type, SUM(c) AS v FROM x GROUP BY 1, 2)
 SELECT user_id, event_type, CAST(v AS BIGINT) AS volume, ROUND(CAST(v AS DOUBLE) / SUM(CAST(v AS DOUBLE)) OVER (PARTITION BY user_id), 6) AS share FROM s WHERE v > 0""")
def type_mix(spark, folder):
    m = world.type_mix(_user_day(spark, folder), ["user_id"], "event_type", "c")
    return m.select("user_id", "event_type", "volume", F.round("share", 6).alias("share"))


@query("stacked_daily_totals", USER_DAY + """ SELECT CAST(day AS VARCHAR) AS day, CAST(SUM(c) AS BIGINT) AS total FROM x GROUP BY 1""")
def stacked_daily_totals(spark, folder):
    t = world.stacked_totals(_user_day(spark, folder), ["day"], "c")
    return t.select(F.col("day").cast("string").alias("day"), "total")


SPEND = {"orders.1-URGENT": 160, "orders.2-HIGH": 60, "orders.3-MEDIUM": 110, "orders.5-LOW": 90}


@query("base_year_index", f"""WITH s AS ({DAILY_PRICE}), g AS (SELECT series_id, MAX(obs_start) AS latest, arg_max(value, obs_start) AS v,
   AVG(value) FILTER (WHERE obs_start BETWEEN DATE '1998-01-01' AND DATE '1998-12-31') AS b FROM s
   WHERE series_id IN ('orders.1-URGENT', 'orders.2-HIGH', 'orders.3-MEDIUM', 'orders.5-LOW') GROUP BY 1),
 p AS (SELECT *, CASE series_id WHEN 'orders.1-URGENT' THEN 160.0::DOUBLE WHEN 'orders.2-HIGH' THEN 60.0::DOUBLE WHEN 'orders.3-MEDIUM' THEN 110.0::DOUBLE ELSE 90.0::DOUBLE END AS spend FROM g)
 SELECT series_id, CAST(latest AS VARCHAR) AS latest, ROUND(v / b * 100, 5) AS index_100, ROUND(spend * v / b, 5) AS spend_now, ROUND(spend * v / b - spend, 5) AS difference FROM p""")
def base_year_index(spark, folder):
    h = derived.household_costs(B.daily_price(spark, folder), "series_id", "obs_start", "value", SPEND, "1998-01-01", "1998-12-31")
    return h.select("series_id", F.col("latest").cast("string").alias("latest"),
                    *[F.round(c, 5).alias(c) for c in ("index_100", "spend_now", "difference")])


YEARLY = """WITH y AS (SELECT l_returnflag AS flag, CAST(year(l_shipdate) AS INTEGER) AS y,
   CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS DOUBLE) / 100.0 / COUNT(*) AS rate,
   CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / COUNT(*) AS price,
   CAST(SUM(CAST(ROUND(l_extendedprice * l_tax * 100) AS BIGINT)) AS DOUBLE) / 100.0 / COUNT(*) AS tax FROM lineitem GROUP BY 1, 2)"""


def _yearly(spark, folder):
    li = B.table(spark, folder, "lineitem")
    g = li.groupBy(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("y")).agg(
        F.sum(B.cents("l_discount")).alias("d"), F.sum(B.cents("l_extendedprice")).alias("p"),
        F.sum(F.round(F.col("l_extendedprice") * F.col("l_tax") * 100).cast("bigint")).alias("t"), F.count("*").alias("n"))
    return g.select("flag", "y", *[(F.col(a).cast("double") / 100.0 / F.col("n")).alias(b) for a, b in (("d", "rate"), ("p", "price"), ("t", "tax"))])


@query("chained_index_real_prices", YEARLY + """, i AS (SELECT *, CASE WHEN y < 1997 THEN 74.4 / 88.6 ELSE
   exp(SUM(CASE WHEN y > 1997 THEN ln(1 + rate) ELSE 0 END) OVER (PARTITION BY flag ORDER BY y)) END AS idx FROM y)
 SELECT flag, y, ROUND(idx, 5) AS price_index, ROUND(price * (MAX(CASE WHEN y = 2001 THEN idx END) OVER (PARTITION BY flag) / idx), 3) AS real_price FROM i""")
def chained_index_real_prices(spark, folder):
    r = derived.real_prices(_yearly(spark, folder), "y", "rate", ["price"], 2001, 1997, by=["flag"])
    return r.select("flag", "y", F.round("price_index", 5).alias("price_index"), F.round("real_price", 3).alias("real_price"))


@query("component_shares", YEARLY + """ SELECT flag, y, ROUND(tax / price * 100, 5) AS share_tax, ROUND(100 - tax / price * 100, 5) AS share_rest FROM y""")
def component_shares(spark, folder):
    s = derived.residual_share(derived.component_shares(_yearly(spark, folder), "price", ["tax"]), "share_tax")
    return s.select("flag", "y", F.round("share_tax", 5).alias("share_tax"), F.round("share_rest", 5).alias("share_rest"))


@query("real_change", YEARLY + """ SELECT flag, ROUND((MAX(CASE WHEN y = 2001 THEN price END) / MAX(CASE WHEN y = 1996 THEN price END) - 1) * 100, 5) AS change_pct FROM y GROUP BY 1""")
def real_change(spark, folder):
    c = derived.real_change(_yearly(spark, folder), ["flag"], "y", "price", 1996, 2001)
    return c.select("flag", F.round("change_pct", 5).alias("change_pct"))


DENSE = f"""WITH s AS ({DAILY_COUNT}), sp AS (SELECT series_id, CAST(UNNEST(generate_series(MIN(obs_start), MAX(obs_start), INTERVAL 1 DAY)) AS DATE) AS obs_start
   FROM s GROUP BY series_id), d AS (SELECT sp.series_id, sp.obs_start, s.value FROM sp LEFT JOIN s USING (series_id, obs_start)),
 m6 AS (SELECT *, CASE WHEN COUNT(value) OVER w >= 6 THEN AVG(value) OVER w END AS m7, CASE WHEN COUNT(value) OVER w >= 4 THEN AVG(value) OVER w END AS m4,
   COUNT(value) OVER w AS n FROM d WINDOW w AS (PARTITION BY series_id ORDER BY obs_start ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


@query("rolling_mean_7d", DENSE + """ SELECT series_id, CAST(obs_start AS VARCHAR) AS obs_start, value, n AS n_observed, ROUND(m7, 6) AS mean_7d FROM m6""")
def rolling_mean_7d(spark, folder):
    d = rolling_mean(densify_daily(B.daily_count(spark, folder).select("series_id", "obs_start", "value"), ["series_id"], "obs_start"),
                     ["series_id"], "obs_start", "value", 7, 6, "mean_7d")
    return d.select("series_id", F.col("obs_start").cast("string").alias("obs_start"), "value", F.col("mean_7d_n").alias("n_observed"),
                    F.round("mean_7d", 6).alias("mean_7d"))


@query("quantile_band", DENSE + """ SELECT series_id, COUNT(m7) AS n_points, ROUND(QUANTILE_CONT(m7, 0.05), 5) AS band_low, ROUND(MEDIAN(m7), 5) AS band_median,
 ROUND(QUANTILE_CONT(m7, 0.95), 5) AS band_high FROM m6 WHERE obs_start BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND m7 IS NOT NULL GROUP BY 1 HAVING COUNT(m7) >= 20""")
def quantile_band_query(spark, folder):
    d = rolling_mean(densify_daily(B.daily_count(spark, folder).select("series_id", "obs_start", "value"), ["series_id"], "obs_start"),
                     ["series_id"], "obs_start", "value", 7, 6, "mean_7d")
    b = quantile_band(d.where(F.col("obs_start").between(F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))), ["series_id"], "mean_7d")
    return b.where("band_low IS NOT NULL").select("series_id", "n_points", *[F.round(c, 5).alias(c) for c in ("band_low", "band_median", "band_high")])


@query("change_class", DENSE + """, b AS (SELECT series_id, ROUND(AVG(value), 2) AS base FROM s WHERE obs_start BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY 1),
 l AS (SELECT series_id, obs_start AS last_day, m4 AS m FROM m6 WHERE value IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY obs_start DESC) = 1),
 c AS (SELECT l.*, b.base, m / base - 1 AS ch FROM l JOIN b USING (series_id))
 SELECT series_id, CAST(last_day AS VARCHAR) AS last_day, ROUND(m, 5) AS mean_7d, base AS baseline_mean, ROUND(ch, 5) AS change,
 CASE WHEN ch IS NULL THEN 'dv-na' WHEN ch <= -0.5 THEN 'dv-n2' WHEN ch <= -0.15 THEN 'dv-n1' WHEN ch <= 0.15 THEN 'dv-0' WHEN ch <= 0.5 THEN 'dv-p1' ELSE 'dv-p2' END AS change_class FROM c""")
def change_class(spark, folder):
    obs = B.daily_count(spark, folder).select("series_id", "obs_start", "value")
    base = world.baseline_means(obs, ["series_id"], "obs_start", "value", "1998-01-01", "1998-12-31")
    m = world.map_state(obs, base, "obs_start")
    return m.select("series_id", F.col("last_day").cast("string").alias("last_day"), F.round("mean_7d", 5).alias("mean_7d"),
                    "baseline_mean", F.round("change", 5).alias("change"), "change_class")


@query("world_payload", f"""WITH s AS ({DAILY_COUNT}), k AS (SELECT DISTINCT series_id FROM s), g AS (SELECT series_id, CAST(UNNEST(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS obs_start FROM k)
 SELECT series_id, COUNT(*) AS n, string_agg(COALESCE(CAST(CAST(value AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY obs_start) AS vals FROM g LEFT JOIN s USING (series_id, obs_start) GROUP BY 1""")
def world_payload(spark, folder):
    p = world.dense_arrays(B.daily_count(spark, folder), ["series_id"], "obs_start", "value", "1995-01-01", "2001-08-01")
    return p.select("series_id", F.size("values").cast("bigint").alias("n"), F.array_join(
        F.transform("values", lambda v: F.coalesce(v.cast("bigint").cast("string"), F.lit("-"))), ",").alias("vals"))


@query("market_tiles", f"""WITH s AS ({DAILY_PRICE}), l AS (SELECT series_id, MAX(obs_start) AS d, arg_max(value, obs_start) AS v FROM s GROUP BY 1),
 r AS (SELECT series_id, MAX(obs_start) AS rd, arg_max(value, obs_start) AS rv FROM s WHERE obs_start <= DATE '2000-02-27' GROUP BY 1)
 SELECT series_id, CAST(d AS VARCHAR) AS last_day, ROUND(v, 2) AS last_value, CAST(rd AS VARCHAR) AS ref_day, ROUND(rv, 2) AS ref_value FROM l JOIN r USING (series_id)
 WHERE series_id IN ('orders.1-URGENT', 'orders.5-LOW')""")
def market_tiles(spark, folder):
    t = world.tiles(B.daily_price(spark, folder), {"orders.1-URGENT": "Urgent", "orders.5-LOW": "Low"}, "2000-02-27")
    return t.select("series_id", F.col("last_day").cast("string").alias("last_day"), F.round("last_value", 2).alias("last_value"),
                    F.col("ref_day").cast("string").alias("ref_day"), F.round("ref_value", 2).alias("ref_value"))


@query("previous_year_value", f"""WITH s AS ({DAILY_CRUDE}) SELECT CAST(a.obs_start AS VARCHAR) AS obs_start, ROUND(a.value + 1e-9, 4) AS value, ROUND(b.value + 1e-9, 4) AS last_year
 FROM s a LEFT JOIN s b ON b.obs_start = CAST(a.obs_start - INTERVAL 1 YEAR AS DATE)""")
def previous_year_value(spark, folder):
    d = derived.previous_year(B.daily_crude(spark, folder), ["pair"], "obs_start", "value", "last_year")
    return d.select(F.col("obs_start").cast("string").alias("obs_start"), F.round(F.col("value") + 1e-9, 4).alias("value"), F.round(F.col("last_year") + 1e-9, 4).alias("last_year"))
