"""Measurements around reported events, claim assessment, cards."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..config import PRICE_DAILY
from ..operators.findings import alert_episodes, latest_of_episode
from ..plans import cards as C
from ..plans import reports, rules
from .base import DAILY_PRICE, price_points_sql, query
from .text import TOPIC_SQL, TOPICS, WORDS

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LINKED = {"english": ["orders.1-URGENT", "orders.2-HIGH"], "french": ["orders.3-MEDIUM"], "german": ["orders.5-LOW"]}
CARD_TOPICS = {k: {**v, "series": LINKED[k], "label": k.title(), "geography": "EU" if k == "german" else "World",
                   "alternatives": [f"{k} wording"]} for k, v in TOPICS.items()}
POINTS = price_points_sql(DAILY_PRICE, 250, 60, 5, 4.0, 2.0)
FOUND = """, pf AS (SELECT series_id, obs_start AS fd, CAST(fired AS INTEGER) AS ff FROM points)"""
MEASURE = """, mb AS (SELECT e.series_id, e.d, MAX(CASE WHEN s.obs_start < e.d THEN s.obs_start END) AS bd, MAX(CASE WHEN s.obs_start BETWEEN e.d AND e.d + 10 THEN s.obs_start END) AS ad, MAX(s.obs_start) AS ld,
   COUNT(CASE WHEN s.obs_start >= e.d - 30 AND s.obs_start < e.d THEN s.value END) AS ctx_n, MEDIAN(CASE WHEN s.obs_start >= e.d - 30 AND s.obs_start < e.d THEN s.value END) AS ctx_median,
   MIN(CASE WHEN s.obs_start >= e.d - 30 AND s.obs_start < e.d THEN s.value END) AS ctx_min, MAX(CASE WHEN s.obs_start >= e.d - 30 AND s.obs_start < e.d THEN s.value END) AS ctx_max FROM ev e JOIN s USING (series_id) GROUP BY 1, 2),
 ms AS (SELECT mb.*, ad IS NOT NULL AS post, cur.value AS v, CASE WHEN ad IS NOT NULL THEN prv.value END AS pv FROM mb JOIN s cur ON cur.series_id = mb.series_id AND cur.obs_start = COALESCE(ad, ld)
   LEFT JOIN s prv ON prv.series_id = mb.series_id AND prv.obs_start = mb.bd)"""


def _series(spark):
    rows = [(f"orders.{p}", f"Orders {p}", "USD", "orders", "daily", "World") for p in PRIORITIES]
    return spark.createDataFrame(rows, "series_id string, name string, unit string, source string, frequency string, geography string")


def _findings(spark, folder):
    f = rules.price_rule(B.daily_price(spark, folder), {**PRICE_DAILY, "last_n": None}, z_threshold=2.0)
    return f.withColumns({"anomaly_id": F.concat_ws("|", "rule_id", "series_id", F.col("obs_start").cast("string")),
                          "baseline_median": F.try_element_at("stats", F.lit("baseline_median"))})


@query("event_measurements", POINTS + FOUND + """, ev AS (SELECT DISTINCT 'orders.' || (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[doc_id % 5 + 1] AS series_id,
   CAST(to_timestamp(852076800 + doc_id * 7200) AT TIME ZONE 'UTC' AS DATE) AS d FROM documents)""" + MEASURE + """, fx AS (SELECT ev.series_id, ev.d, MAX(ff) AS fired FROM ev JOIN pf ON pf.series_id = ev.series_id AND pf.fd BETWEEN ev.d - 30 AND ev.d + 10 GROUP BY 1, 2)
 SELECT ms.series_id, CAST(ms.d AS VARCHAR) AS event_day, CAST(post AS INTEGER) AS post_event, ROUND(v + 1e-9, 4) AS latest_value, CAST(COALESCE(ad, ld) AS VARCHAR) AS latest_date, ROUND(pv + 1e-9, 4) AS previous_value,
 ROUND((v - pv) / pv * 100, 5) AS pct_change, ctx_n, ROUND(ctx_median, 3) AS ctx_median, ROUND(ctx_min + 1e-9, 4) AS ctx_min, ROUND(ctx_max + 1e-9, 4) AS ctx_max, fx.fired FROM ms LEFT JOIN fx ON fx.series_id = ms.series_id AND fx.d = ms.d""")
def event_measurements(spark, folder):
    h = B.headlines(spark, folder)
    names = F.array(*[F.lit(f"orders.{p}") for p in PRIORITIES])
    ev = h.select(F.get(names, F.pmod("headline_id", F.lit(5)).cast("int")).alias("series_id"), F.to_date("discovered_at").alias("event_day"))
    m = C.measure(ev, B.daily_price(spark, folder), _series(spark), _findings(spark, folder))
    return m.select(
        "series_id", F.col("event_day").cast("string").alias("event_day"), F.col("post_event").cast("int").alias("post_event"),
        F.round(F.col("latest_value") + 1e-9, 4).alias("latest_value"), F.col("latest_date").cast("string").alias("latest_date"),
        F.round(F.col("previous_value") + 1e-9, 4).alias("previous_value"), F.round("pct_change", 5).alias("pct_change"), "ctx_n",
        F.round("ctx_median", 3).alias("ctx_median"), F.round(F.col("ctx_min") + 1e-9, 4).alias("ctx_min"),
        F.round(F.col("ctx_max") + 1e-9, 4).alias("ctx_max"), F.col("finding.fired").cast("int").alias("fired"))


def _cards(spark, folder):
    return C.headline_cards(B.headlines(spark, folder), B.daily_price(spark, folder), _series(spark), _findings(spark, folder),
                            F.lit("1997-04-01").cast("date"), CARD_TOPICS, words=WORDS)


LINKS = " UNION ALL ".join(f"SELECT '{t}' AS topic, '{s}' AS series_id, {i} AS pos" for t, ss in LINKED.items() for i, s in enumerate(ss))
ASSESS = (POINTS + FOUND + ", " + TOPIC_SQL.removeprefix("WITH ") + f""", lk AS ({LINKS}),
 tl AS (SELECT doc_id, len(hits) AS nh, topic FROM m WHERE len(hits) > 0), w AS (SELECT doc_id, series_id, MIN(topic || pos) AS ord, CAST(to_timestamp(852076800 + doc_id * 7200) AT TIME ZONE 'UTC' AS DATE) AS d FROM tl JOIN lk USING (topic) GROUP BY 1, 2),
 ev AS (SELECT DISTINCT series_id, d FROM w)""" + MEASURE + f""", fx AS (SELECT ev.series_id, ev.d, MAX(ff) AS fired, COUNT(*) AS nf FROM ev JOIN pf ON pf.series_id = ev.series_id AND pf.fd BETWEEN ev.d - 30 AND ev.d + 10 GROUP BY 1, 2),
 wm AS (SELECT w.doc_id, w.ord, ms.*, (v - pv) / pv * 100 AS pct, fx.fired, fx.nf FROM w JOIN ms ON ms.series_id = w.series_id AND ms.d = w.d LEFT JOIN fx ON fx.series_id = w.series_id AND fx.d = w.d),
 pr AS (SELECT * FROM wm WHERE post QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY ord) = 1),
 cl AS (SELECT doc_id, ({' OR '.join(f"contains(t, '{x}')" for x in WORDS['up'])}) AS up, ({' OR '.join(f"contains(t, '{x}')" for x in WORDS['down'])}) AS down FROM d),
 hd AS (SELECT doc_id, SUM(nh) AS n_hits, string_agg(topic, ',' ORDER BY topic) AS topics FROM tl GROUP BY 1),
 a AS (SELECT hd.*, CASE WHEN up AND NOT down THEN 'up' WHEN down AND NOT up THEN 'down' END AS claim, pr.pct, pr.doc_id IS NOT NULL AS has_post,
   CASE WHEN abs(pr.pct) < 1 THEN 'flat' WHEN pr.pct > 0 THEN 'up' WHEN pr.pct <= 0 THEN 'down' END AS move FROM hd JOIN cl USING (doc_id) LEFT JOIN pr USING (doc_id))""")


@query("claim_assessment", ASSESS + """ SELECT doc_id, topics, claim, move, CASE WHEN NOT has_post THEN 'insufficient_evidence' WHEN claim IS NULL THEN 'context_only' WHEN move IS NULL THEN 'insufficient_evidence'
 WHEN move = claim THEN 'supports' ELSE 'complicates' END AS relationship FROM a""")
def claim_assessment(spark, folder):
    c = _cards(spark, folder)
    post = F.get(F.filter("measurements", lambda m: m["post_event"]), 0)
    claim = F.when(F.array_contains("claims", "up"), "up").when(F.array_contains("claims", "down"), "down")
    pct = post["pct_change"]
    move = F.when(F.abs(pct) < 1, "flat").when(pct > 0, "up").when(pct <= 0, "down")
    return c.select(F.col("headline_id").alias("doc_id"), F.array_join("topics", ",").alias("topics"), claim.alias("claim"), move.alias("move"), "relationship")


@query("quality_ratings", ASSESS + """, qq AS (SELECT doc_id, COUNT(*) FILTER (WHERE post) AS n_post, COUNT(*) FILTER (WHERE post AND nf > 0) AS n_found FROM wm GROUP BY 1)
 SELECT hd.doc_id, CAST(hd.n_hits AS BIGINT) AS n_hits, COALESCE(n_post, 0) AS n_post_event, CASE WHEN hd.n_hits >= 2 AND contains(hd.topics, 'german') THEN 'high' WHEN hd.n_hits >= 1 THEN 'medium' ELSE 'low' END AS editorial_relevance
 FROM hd LEFT JOIN qq USING (doc_id)""")
def quality_ratings(spark, folder):
    c = _cards(spark, folder)
    return c.select(F.col("headline_id").alias("doc_id"), "n_hits", F.col("n_post_event").cast("bigint").alias("n_post_event"), "editorial_relevance")


@query("headline_cards")
def headline_cards(spark, folder):
    c = _cards(spark, folder)
    return c.select("card_id", "relationship", "relationship_reason", "signal_strength", "evidence_quality", "freshness", "follow_up", "review_flag",
                    F.length("narrative").alias("narrative_length"), F.size("input_version_ids").alias("n_inputs"), F.array_join("charts", ",").alias("charts"))


@query("anomaly_cards", price_points_sql(DAILY_PRICE, 250, 60, 5, 4.0, 1.5) + """,
 a AS (SELECT series_id, obs_start, method, CASE WHEN date_diff('day', LAG(obs_start) OVER w, obs_start) <= 3 THEN 0 ELSE 1 END AS starts FROM points WHERE fired WINDOW w AS (PARTITION BY series_id ORDER BY obs_start)),
 e AS (SELECT *, SUM(starts) OVER (PARTITION BY series_id ORDER BY obs_start) AS no FROM a),
 g AS (SELECT series_id, MIN(obs_start) AS s0, MAX(obs_start) AS s1, arg_max(method, obs_start) AS method FROM e GROUP BY series_id, no)
 SELECT 'a-' || substr(sha1('price_daily|' || series_id || '|' || CAST(s0 AS VARCHAR)), 1, 20) AS card_id, series_id, CAST(s1 AS VARCHAR) AS latest, CASE WHEN method = 'MAD' THEN 'high' ELSE 'medium' END AS evidence_quality,
 'medium' AS editorial_relevance FROM g""")
def anomaly_cards(spark, folder):
    f = rules.price_rule(B.daily_price(spark, folder), {**PRICE_DAILY, "last_n": None}, z_threshold=1.5)
    ep = latest_of_episode(alert_episodes(f))
    none = spark.createDataFrame([], "series_id string, episode_start date, n_related bigint")
    c = C.anomaly_cards(ep, _series(spark), none)
    return c.select("card_id", "series_id", F.col("obs_start").cast("string").alias("latest"), "evidence_quality", "editorial_relevance")


@query("context_cards", f"""WITH s AS ({DAILY_PRICE}), l AS (SELECT series_id, MAX(obs_start) AS d FROM s GROUP BY 1),
 c AS (SELECT l.series_id, l.d, COUNT(*) FILTER (WHERE s.obs_start >= l.d - 30 AND s.obs_start < l.d) AS n, MEDIAN(s.value) FILTER (WHERE s.obs_start >= l.d - 30 AND s.obs_start < l.d) AS med,
   arg_max(s.value, s.obs_start) AS v, arg_max(s.value, s.obs_start) FILTER (WHERE s.obs_start < l.d) AS pv FROM l JOIN s USING (series_id) GROUP BY 1, 2)
 SELECT 'c-' || series_id AS card_id, CAST(d AS VARCHAR) AS latest_date, ROUND(v + 1e-9, 4) AS latest_value, ROUND((v - pv) / pv * 100, 5) AS pct_change, n AS ctx_n, ROUND(med, 3) AS ctx_median FROM c""")
def context_cards(spark, folder):
    keys = [f"orders.{p}" for p in PRIORITIES]
    c = C.context_cards(B.daily_price(spark, folder), _series(spark), _findings(spark, folder), keys, F.lit("2001-08-05").cast("date"))
    return c.select("card_id", F.col("latest_date").cast("string").alias("latest_date"), F.round(F.col("latest_value") + 1e-9, 4).alias("latest_value"),
                    F.round("pct_change", 5).alias("pct_change"), "ctx_n", F.round("ctx_median", 3).alias("ctx_median"))


@query("latest_alerts", price_points_sql(DAILY_PRICE, 250, 60, 5, 4.0, 2.0) + """ SELECT series_id, CAST(MAX(obs_start) AS VARCHAR) AS obs_end FROM points WHERE fired GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""")
def latest_alerts(spark, folder):
    a = reports.latest_alerts(_findings(spark, folder), _series(spark))
    return a.select("series_id", F.col("obs_end").cast("string").alias("obs_end"))
