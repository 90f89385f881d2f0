"""Screening rules on price, stock and transit series."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..config import FUEL_LAG, INVENTORY, LITRES_PER_BARREL, PRICE_DAILY, PRICE_WEEKLY, SHIPPING
from ..operators.findings import alert_episodes, latest_of_episode
from ..operators.regress import lag_design, lag_findings, lag_residuals, passthrough_periods
from ..plans import rules
from ..plans.derived import aligned_crude, euro_crude
from ..plans.digest import rank_alerts
from .base import DAILY_COUNT, DAILY_CRUDE, DAILY_PRICE, FIXING, WEEKLY_PRICE, price_points_sql, query

ALL_DAILY = {**PRICE_DAILY, "last_n": None}
ALL_WEEKLY = {**PRICE_WEEKLY, "last_n": None}
ALL_STOCK = {**INVENTORY, "last_n": None}
ALL_SHIPPING = {**SHIPPING, "last_n": None, "min_abs_change": 0.5}
BASE_YEAR = {"start": "1998-01-01", "end": "1998-12-31"}

POINT_COLUMNS = """SELECT series_id, CAST(obs_start AS VARCHAR) AS obs_start, ROUND(value + 1e-9, 4) AS value, ROUND(ret, 6) AS log_return,
 ROUND(pct, 4) AS pct_change, ROUND(z, 5) AS z, method, n AS n_baseline, CAST(fired AS INTEGER) AS fired,
 ROUND(severity, 5) AS severity FROM points"""


def _points(df):
    return df.select(
        "series_id", F.col("obs_start").cast("string").alias("obs_start"), F.round(F.col("value") + 1e-9, 4).alias("value"),
        F.round("ret", 6).alias("log_return"), F.round("pct_change", 4).alias("pct_change"), F.round("z", 5).alias("z"),
        "method", F.col("n_baseline").cast("bigint").alias("n_baseline"), F.col("fired").cast("int").alias("fired"),
        F.round("severity_rank", 5).alias("severity"))


@query("unusual_daily_moves", price_points_sql(DAILY_PRICE, 250, 60, 5, 4.0) + POINT_COLUMNS)
def unusual_daily_moves(spark, folder):
    return _points(rules.price_points(B.daily_price(spark, folder), ALL_DAILY))


@query("latest_daily_moves", price_points_sql(DAILY_PRICE, 250, 60, 5, 4.0) + """,
 k AS (SELECT series_id, obs_start, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY obs_start DESC) AS rn FROM s WHERE value > 0)
 SELECT series_id, CAST(obs_start AS VARCHAR) AS obs_start, ROUND(value + 1e-9, 4) AS value, ROUND(ret, 6) AS log_return,
 ROUND(pct, 4) AS pct_change, ROUND(z, 5) AS z, method, n AS n_baseline, CAST(fired AS INTEGER) AS fired,
 ROUND(severity, 5) AS severity FROM points JOIN k USING (series_id, obs_start) WHERE rn <= 30""")
def latest_daily_moves(spark, folder):
    return _points(rules.price_points(B.daily_price(spark, folder), PRICE_DAILY))


@query("unusual_weekly_moves", price_points_sql(WEEKLY_PRICE, 156, 52, 15, 3.0) + POINT_COLUMNS)
def unusual_weekly_moves(spark, folder):
    return _points(rules.price_points(B.weekly_price(spark, folder), ALL_WEEKLY))


@query("seasonal_inventory", f"""WITH s AS ({WEEKLY_PRICE}),
 d AS (SELECT series_id, obs_start + 6 AS obs_end, value, CASE WHEN date_diff('day', LAG(obs_start) OVER w, obs_start) <= 8
   THEN value - LAG(value) OVER w END AS chg FROM s WINDOW w AS (PARTITION BY series_id ORDER BY obs_start)),
 e AS (SELECT *, isoyear(obs_end) AS y, weekofyear(obs_end) AS w FROM d),
 j AS (SELECT t.series_id, t.obs_end, t.value, t.chg, h.chg AS hc, h.value AS hv FROM e t LEFT JOIN e h ON h.series_id = t.series_id
   AND h.y BETWEEN t.y - 5 AND t.y - 1 AND h.obs_end < t.obs_end
   AND h.w IN ((t.w - 2 + 52) % 52 + 1, (t.w - 1) % 52 + 1, t.w % 52 + 1) WHERE t.chg IS NOT NULL),
 g AS (SELECT series_id, obs_end, ANY_VALUE(value) AS value, ANY_VALUE(chg) AS chg, COUNT(hc) AS n, MEDIAN(hc) AS med, MAD(hc) AS mad,
   QUANTILE_CONT(hc, 0.75) - QUANTILE_CONT(hc, 0.25) AS iqr, MEDIAN(hv) AS level FROM j GROUP BY 1, 2),
 z AS (SELECT *, CASE WHEN n < 8 THEN NULL WHEN mad > 0 THEN 0.67449 * (chg - med) / mad WHEN iqr > 0 THEN 1.349 * (chg - med) / iqr END AS z FROM g)
 SELECT series_id, CAST(obs_end AS VARCHAR) AS obs_end, ROUND(chg, 5) AS change, n AS n_baseline, ROUND(z, 5) AS z,
 ROUND(value - level, 5) AS level_vs_seasonal_median, CAST(COALESCE(abs(z) >= 3.5, FALSE) AS INTEGER) AS fired FROM z""")
def seasonal_inventory(spark, folder):
    t = rules.inventory_points(B.weekly_price(spark, folder), ALL_STOCK)
    return t.select("series_id", F.col("obs_end").cast("string").alias("obs_end"), F.round("change", 5).alias("change"),
                    F.col("n_baseline").cast("bigint").alias("n_baseline"), F.round("z", 5).alias("z"),
                    F.round("level_vs_seasonal_median", 5).alias("level_vs_seasonal_median"),
                    F.col("fired").cast("int").alias("fired"))


TRANSIT = f"""WITH s AS ({DAILY_COUNT}), sp AS (SELECT series_id, CAST(UNNEST(generate_series(MIN(obs_start), MAX(obs_start), INTERVAL 1 DAY)) AS DATE) AS obs_start
   FROM s GROUP BY series_id), d AS (SELECT sp.series_id, sp.obs_start, s.value FROM sp LEFT JOIN s USING (series_id, obs_start)),
 m AS (SELECT *, COUNT(value) OVER w AS n, CASE WHEN COUNT(value) OVER w >= 6 THEN AVG(value) OVER w END AS m7, SUM(value) OVER w AS sm,
   obs_start BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AS in_base FROM d
   WINDOW w AS (PARTITION BY series_id ORDER BY obs_start ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
 bq AS (SELECT series_id, QUANTILE_CONT(m7, 0.05) AS qlo, MEDIAN(m7) AS med, QUANTILE_CONT(m7, 0.95) AS qhi, COUNT(m7) AS nb FROM m WHERE in_base GROUP BY 1),
 wm AS (SELECT series_id, isodow(obs_start) AS dow, AVG(value) AS wmean FROM m WHERE in_base GROUP BY 1, 2),
 x AS (SELECT m.*, bq.qlo, bq.med, bq.qhi, COALESCE(bq.nb, 0) AS nb, wm.wmean, SUM(CASE WHEN m.value IS NOT NULL THEN wm.wmean END) OVER w AS expd,
   COUNT(CASE WHEN m.value IS NOT NULL THEN wm.wmean END) OVER w AS nexp FROM m LEFT JOIN bq USING (series_id)
   LEFT JOIN wm ON wm.series_id = m.series_id AND wm.dow = isodow(m.obs_start)
   WINDOW w AS (PARTITION BY m.series_id ORDER BY m.obs_start ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
 y AS (SELECT x.*, CASE WHEN value IS NULL THEN 'suppressed: no observation for this day' WHEN m7 IS NULL THEN 'suppressed: too few observed days'
   WHEN nb = 0 THEN 'not evaluated: baseline window empty' WHEN in_base THEN 'not evaluated: inside the baseline window' ELSE 'evaluated' END AS ev FROM x),
 c AS (SELECT *, COALESCE(ev = 'evaluated' AND (m7 < qlo OR m7 > qhi) AND abs(m7 - med) >= 0.5, FALSE) AS cond FROM y),
 f AS (SELECT *, cond AND MIN(CAST(cond AS INTEGER)) OVER r = 1 AND COUNT(*) OVER r = 2 AS fired FROM c
   WINDOW r AS (PARTITION BY series_id ORDER BY obs_start ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
 pos AS (SELECT f.series_id, f.obs_start, AVG(CASE WHEN b.m7 <= f.m7 THEN 1.0 ELSE 0.0 END) AS pos FROM f JOIN m b
   ON b.series_id = f.series_id AND b.in_base AND b.m7 IS NOT NULL WHERE f.ev = 'evaluated' GROUP BY 1, 2)"""


@query("rolling_transit_rule", TRANSIT + """ SELECT f.series_id, CAST(f.obs_start AS VARCHAR) AS obs_start, f.ev AS evaluation, f.n AS n_days_present,
 ROUND(f.m7, 5) AS mean_7d, ROUND(f.med, 5) AS baseline_median, ROUND(f.qlo, 5) AS q_low, ROUND(f.qhi, 5) AS q_high, ROUND(pos.pos, 5) AS empirical_position,
 ROUND(CASE WHEN f.ev = 'evaluated' AND f.expd > 0 AND f.nexp = f.n THEN f.sm / f.expd END, 5) AS weekday_adjusted_ratio,
 ROUND(ly.m7, 5) AS last_year_7d, CAST(f.fired AS INTEGER) AS fired FROM f LEFT JOIN pos USING (series_id, obs_start)
 LEFT JOIN m ly ON ly.series_id = f.series_id AND ly.obs_start = CAST(f.obs_start - INTERVAL 1 YEAR AS DATE)""")
def rolling_transit_rule(spark, folder):
    d = rules.shipping_points(B.daily_count(spark, folder), ALL_SHIPPING, BASE_YEAR)
    return d.select(
        "series_id", F.col("obs_start").cast("string").alias("obs_start"), "evaluation",
        F.col("n_days_present").cast("bigint").alias("n_days_present"),
        *[F.round(c, 5).alias(c) for c in ("mean_7d", "baseline_median", "q_low", "q_high", "empirical_position",
                                           "weekday_adjusted_ratio", "last_year_7d")],
        F.col("fired").cast("int").alias("fired"))


@query("rule_backtest", price_points_sql(DAILY_PRICE, 250, 60, 5, 4.0, 2.0) + """ SELECT series_id,
 COUNT(*) FILTER (WHERE z IS NOT NULL) AS evaluated, COUNT(*) FILTER (WHERE fired) AS fired,
 ROUND(COUNT(*) FILTER (WHERE fired) / NULLIF(COUNT(*) FILTER (WHERE z IS NOT NULL), 0), 6) AS alert_rate,
 COALESCE(string_agg(CASE WHEN fired THEN CAST(obs_start AS VARCHAR) END, ',' ORDER BY obs_start), '') AS fired_dates
 FROM points WHERE obs_start BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY series_id""")
def rule_backtest(spark, folder):
    f = rules.price_rule(B.daily_price(spark, folder), ALL_DAILY, z_threshold=2.0)
    b = rules.backtest(f, "1996-01-01", "2000-12-31")
    return b.select("series_id", "evaluated", "fired", F.round("alert_rate", 6).alias("alert_rate"), F.array_join(
        F.transform("fired_dates", lambda d: d.cast("string")), ",").alias("fired_dates"))


EPISODES = price_points_sql(DAILY_PRICE, 250, 60, 5, 4.0, 1.5) + """,
 a AS (SELECT series_id, obs_start, value, CASE WHEN date_diff('day', LAG(obs_start) OVER w, obs_start) <= 3 THEN 0 ELSE 1 END AS starts
   FROM points WHERE fired WINDOW w AS (PARTITION BY series_id ORDER BY obs_start)),
 e AS (SELECT *, SUM(starts) OVER (PARTITION BY series_id ORDER BY obs_start) AS no FROM a)"""


@query("alert_episodes", EPISODES + """ SELECT series_id, CAST(MIN(obs_start) AS VARCHAR) AS episode_start, CAST(MAX(obs_start) AS VARCHAR) AS latest,
 COUNT(*) AS n_alerts, ROUND(arg_max(value, obs_start) + 1e-9, 4) AS value FROM e GROUP BY series_id, no""")
def alert_episodes_query(spark, folder):
    f = rules.price_rule(B.daily_price(spark, folder), ALL_DAILY, z_threshold=1.5)
    e = latest_of_episode(alert_episodes(f))
    return e.select("series_id", F.col("episode_start").cast("string").alias("episode_start"),
                    F.col("obs_start").cast("string").alias("latest"), "n_alerts", F.round(F.col("value") + 1e-9, 4).alias("value"))


@query("story_digest", price_points_sql(DAILY_PRICE, 250, 60, 5, 4.0, 1.5) + """,
 l AS (SELECT series_id, MAX(obs_start) AS d FROM points WHERE fired AND obs_start >= DATE '1995-01-01' GROUP BY 1)
 SELECT ROW_NUMBER() OVER (ORDER BY LEAST(10, abs(COALESCE(z, 0))) DESC, series_id) AS position, series_id,
 ROUND(LEAST(10, abs(COALESCE(z, 0))), 5) AS score FROM points JOIN l USING (series_id) WHERE obs_start = d
 ORDER BY LEAST(10, abs(COALESCE(z, 0))) DESC, series_id LIMIT 4""")
def story_digest(spark, folder):
    f = rules.price_rule(B.daily_price(spark, folder), ALL_DAILY, z_threshold=1.5)
    names = B.daily_price(spark, folder).select("series_id").distinct().withColumn("name", F.col("series_id"))
    top = rank_alerts(f, names, F.lit("1995-01-01").cast("date"))
    return top.select(F.col("position").cast("bigint").alias("position"), "series_id", F.round("score", 5).alias("score"))


def _lag_pairs(spark, folder):
    return rules.lag_pairs(B.weekly_price(spark, folder), B.daily_crude(spark, folder).withColumn("value", F.col("value") / LITRES_PER_BARREL))


LAG_PAIRS = f"""WITH s AS ({WEEKLY_PRICE}), c AS ({DAILY_CRUDE}),
 al AS (SELECT w.obs_start, AVG(c.value) / 158.987294928 AS crude FROM (SELECT DISTINCT obs_start FROM s) w JOIN c
   ON c.obs_start BETWEEN w.obs_start - 7 AND w.obs_start - 3 GROUP BY 1),
 j AS (SELECT s.series_id, s.obs_start, s.value, al.crude FROM s JOIN al USING (obs_start)),
 d AS (SELECT *, value - LAG(value) OVER w AS dp, crude - LAG(crude) OVER w AS db FROM j WINDOW w AS (PARTITION BY series_id ORDER BY obs_start))"""


@query("lag_model_one_lag", LAG_PAIRS + """, k AS (SELECT * FROM d WHERE dp IS NOT NULL AND db IS NOT NULL),
 f AS (SELECT *, COUNT(*) OVER t AS n, regr_slope(dp, db) OVER t AS b, regr_intercept(dp, db) OVER t AS a FROM k
   WINDOW t AS (PARTITION BY series_id ORDER BY obs_start ROWS BETWEEN 156 PRECEDING AND 1 PRECEDING))
 SELECT series_id, CAST(obs_start AS VARCHAR) AS obs_start, n AS n_train, ROUND(a + b * db, 5) AS predicted, ROUND(dp - (a + b * db), 5) AS residual
 FROM f WHERE n >= 60""")
def lag_model_one_lag(spark, folder):
    from pyspark.sql import Window
    d = lag_design(_lag_pairs(spark, folder), 1)
    t = Window.partitionBy("series_id").orderBy("obs_start").rowsBetween(-156, -1)
    d = d.withColumns({"n_train": F.count("*").over(t), "_b": F.regr_slope("dP", "dB0").over(t),
                       "_a": F.regr_intercept("dP", "dB0").over(t)}).where("n_train >= 60")
    pred = F.col("_a") + F.col("_b") * F.col("dB0")
    return d.select("series_id", F.col("obs_start").cast("string").alias("obs_start"), "n_train",
                    F.round(pred, 5).alias("predicted"), F.round(F.col("dP") - pred, 5).alias("residual"))


@query("lag_model_residual")
def lag_model_residual(spark, folder):
    f = lag_findings(lag_residuals(_lag_pairs(spark, folder), {**FUEL_LAG, "last_n": None}))
    return f.select("series_id", F.col("obs_start").cast("string").alias("obs_start"), "n_train", "suppressed",
                    F.round("residual", 6).alias("residual"), F.round("z", 5).alias("z"), "method", "fired")


@query("asymmetric_passthrough")
def asymmetric_passthrough_query(spark, folder):
    p = _lag_pairs(spark, folder).select(F.col("series_id").alias("product"), "obs_start", F.col("value").alias("retail"), "crude")
    return passthrough_periods(p, {"whole": (None, None, 4), "late": ("2001-06-01", None, 2)})


@query("asof_convert", f"""WITH c AS ({DAILY_CRUDE}), f AS (SELECT CAST(l_shipdate AS DATE) AS fx_date,
   1 + CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS DOUBLE) / 100.0 / COUNT(*) AS fx FROM lineitem
   WHERE isodow(l_shipdate) IN (1, 4) GROUP BY 1),
 j AS (SELECT c.obs_start, c.value, f.fx_date, f.fx FROM c ASOF JOIN f ON c.obs_start >= f.fx_date)
 SELECT CAST(obs_start AS VARCHAR) AS obs_start, CAST(fx_date AS VARCHAR) AS fx_date, ROUND(value / fx + 1e-9, 5) AS eur_bbl,
 ROUND(value / fx / 158.987294928, 6) AS eur_litre FROM j WHERE date_diff('day', fx_date, obs_start) <= 3""")
def asof_convert(spark, folder):
    e = euro_crude(B.daily_crude(spark, folder), B.fixing(spark, folder))
    return e.select(F.col("obs_start").cast("string").alias("obs_start"), F.col("fx_date").cast("string").alias("fx_date"),
                    F.round(F.col("eur_bbl") + 1e-9, 5).alias("eur_bbl"), F.round("eur_litre", 6).alias("eur_litre"))


@query("interval_mean", LAG_PAIRS.split("j AS")[0].rstrip().rstrip(",") + """, n AS (SELECT w.obs_start, COUNT(c.value) AS n_days,
   AVG(c.value) / 158.987294928 AS crude FROM (SELECT DISTINCT obs_start FROM s) w LEFT JOIN c
   ON c.obs_start BETWEEN w.obs_start - 7 AND w.obs_start - 3 GROUP BY 1)
 SELECT s.series_id, CAST(s.obs_start AS VARCHAR) AS obs_start, n.n_days, ROUND(n.crude, 5) AS crude_litre,
 ROUND(s.value - n.crude, 5) AS wedge FROM s JOIN n USING (obs_start)""")
def interval_mean_query(spark, folder):
    weekly = B.weekly_price(spark, folder)
    points = weekly.select(F.lit("all").alias("pair"), "obs_start").distinct()
    al = aligned_crude(points, B.daily_crude(spark, folder).withColumn("eur_bbl", F.col("value")))
    from ..plans.derived import cost_wedge
    w = cost_wedge(weekly.withColumn("pair", F.lit("all")), al, ["pair"])
    return w.select("series_id", F.col("obs_start").cast("string").alias("obs_start"), "n_days",
                    F.round("crude_litre", 5).alias("crude_litre"), F.round("wedge", 5).alias("wedge"))


_REVISED = "CASE WHEN day(c.obs_start) = 15 AND year(c.obs_start) = 1998 THEN c.value * 1.1 ELSE c.value END"


@query("derived_versions", f"""WITH s AS ({WEEKLY_PRICE}), c AS ({DAILY_CRUDE}), f AS ({FIXING}),
 e AS (SELECT c.obs_start, c.value / f.fx AS old, {_REVISED} / f.fx AS new, f.fx_date FROM c ASOF JOIN f ON c.obs_start >= f.fx_date WHERE date_diff('day', f.fx_date, c.obs_start) <= 3),
 d AS (SELECT s.series_id, s.obs_start, ANY_VALUE(s.value) AS price, AVG(e.old) / 158.987294928 AS old, AVG(e.new) / 158.987294928 AS new, COUNT(e.old) + COUNT(DISTINCT e.fx_date) + 1 AS n_inputs
   FROM s LEFT JOIN e ON e.obs_start BETWEEN s.obs_start - 7 AND s.obs_start - 3 GROUP BY 1, 2),
 changed AS (SELECT *, abs((price - old) - (price - new)) > 1e-9 * GREATEST(1, abs(price - old)) AS again FROM d)
 SELECT 'wedge.' || series_id AS series_id, CAST(obs_start AS VARCHAR) AS obs_start, 1 AS revision_no, ROUND(price - old, 5) AS value, n_inputs, NOT coalesce(again, FALSE) AS is_current FROM changed
 UNION ALL SELECT 'wedge.' || series_id, CAST(obs_start AS VARCHAR), 2, ROUND(price - new, 5), n_inputs, TRUE FROM changed WHERE again""")
def derived_versions(spark, folder):
    """The wedge of all weeks, then crude of the 15th of every month of 1998 is revised and only the weeks it reaches are made again."""
    from ..operators.partitioned import ROWS
    from ..operators.versioned import merge_observations
    from ..plans.derived_store import WedgeInputs, refresh_wedge, wedge_rows
    from ..session import cut_lineage
    t0, t1 = (F.lit(t).cast("timestamp") for t in ("2001-01-01", "2001-01-02"))
    crude = B.daily_crude(spark, folder).select(F.lit("crude").alias("series_id"), "obs_start", "value")
    rate = B.fixing(spark, folder).select(F.lit("rate").alias("series_id"), F.col("fx_date").alias("obs_start"), F.col("fx").alias("value"))
    first = crude.unionByName(rate).unionByName(B.weekly_price(spark, folder).select("series_id", "obs_start", "value"))
    empty = spark.createDataFrame([], ROWS)
    obs = cut_lineage(merge_observations(empty, first, t0)[0])
    series = WedgeInputs("crude", "rate", F.col("series_id").startswith("lineitem."))
    derived = cut_lineage(merge_observations(empty, wedge_rows(obs.where("is_current"), series), t0)[0])
    revised = crude.where((F.dayofmonth("obs_start") == 15) & (F.year("obs_start") == 1998)).withColumn("value", F.col("value") * 1.1)
    obs = cut_lineage(merge_observations(obs, revised, t1)[0])
    table, _ = refresh_wedge(derived, obs, series, t1, t1)
    return table.select("series_id", F.col("obs_start").cast("string").alias("obs_start"), "revision_no", F.round("value", 5).alias("value"),
                        F.size(F.from_json("attrs", "inputs array<string>")["inputs"]).cast("bigint").alias("n_inputs"), "is_current")


_DAILY_POINTS = price_points_sql(DAILY_PRICE, 250, 60, 5, 4.0)
_WEEKLY_POINTS = price_points_sql(WEEKLY_PRICE, 156, 52, 15, 3.0)


@query("rule_run", f"""WITH daily AS ({_DAILY_POINTS} SELECT series_id, obs_start, fired FROM points), weekly AS ({_WEEKLY_POINTS} SELECT series_id, obs_start, fired FROM points),
 ds AS (SELECT obs_start FROM ({DAILY_PRICE}) WHERE series_id = 'orders.1-URGENT' AND value > 0 ORDER BY obs_start DESC LIMIT 30),
 ws AS (SELECT obs_start FROM ({WEEKLY_PRICE}) WHERE series_id = 'lineitem.A' AND value > 0 ORDER BY obs_start DESC LIMIT 6)
 SELECT 'price_daily' AS rule_id, 'eia.brent_spot' AS series_id, 'active' AS status, COUNT(*) AS n, CAST(SUM(CAST(fired AS INTEGER)) AS BIGINT) AS n_price_fired FROM daily JOIN ds USING (obs_start) WHERE series_id = 'orders.1-URGENT'
 UNION ALL SELECT 'price_weekly', 'oil_bulletin.de.diesel.without_tax', 'active', COUNT(*), CAST(SUM(CAST(fired AS INTEGER)) AS BIGINT) FROM weekly JOIN ws USING (obs_start) WHERE series_id = 'lineitem.A'
 UNION ALL SELECT 'shipping_7d', 'portwatch.hormuz.n_tanker', 'active', 21, 0 UNION ALL SELECT 'shipping_7d', 'portwatch.suez.n_tanker', 'not_screened', 21, 0
 UNION ALL SELECT 'fuel_lag_resid', 'oil_bulletin.de.diesel.without_tax', 'active', 6, 0""")
def rule_run(spark, folder):
    """All rules over one store of versions, then again after one passage left the screening: nothing new, its findings set aside."""
    from ..operators.partitioned import ROWS
    from ..operators.versioned import merge_observations
    from ..session import cut_lineage
    from .stores import _stored

    def named(df, which, name, value=F.col("value")):
        return df.where(F.col("series_id") == which).select(F.lit(name).alias("series_id"), "obs_start", value.alias("value"))
    daily, count = B.daily_price(spark, folder), B.daily_count(spark, folder)
    crude = B.daily_crude(spark, folder).withColumn("series_id", F.lit("crude"))
    pump = "oil_bulletin.de.diesel.without_tax"
    batch = (named(daily, "orders.1-URGENT", "eia.brent_spot").unionByName(named(B.weekly_price(spark, folder), "lineitem.A", pump))
             .unionByName(named(count, "orders.2-HIGH", "portwatch.hormuz.n_tanker")).unionByName(named(count, "orders.5-LOW", "portwatch.suez.n_tanker"))
             .unionByName(named(crude, "crude", "derived.brent_eur_per_litre", F.col("value") / LITRES_PER_BARREL)))
    versions = cut_lineage(merge_observations(spark.createDataFrame([], ROWS), batch, F.lit("2001-01-01").cast("timestamp"))[0])
    series = spark.createDataFrame([("eia.brent_spot", "EIA", "daily", "USD per barrel"), (pump, "EU Oil Bulletin", "weekly", "EUR per litre"), ("portwatch.hormuz.n_tanker", "IMF PortWatch", "daily", "transits"),
                                    ("portwatch.suez.n_tanker", "IMF PortWatch", "daily", "transits")], "series_id string, source string, frequency string, unit string")
    empty = _stored(spark, rules.price_rule(daily))
    table, _ = rules.screen(empty, versions, series, F.lit("2001-01-02").cast("timestamp"), ["hormuz", "suez"])
    table, _ = rules.screen(cut_lineage(table), versions, series, F.lit("2001-01-03").cast("timestamp"), ["hormuz"])
    price = F.col("rule_id").startswith("price_")
    return table.groupBy("rule_id", "series_id", "status").agg(F.count("*").alias("n"), F.count_if(F.col("fired") & price).alias("n_price_fired"))
