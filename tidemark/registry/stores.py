"""Versioned tables, finding and card stores, upserts, reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..config import PRICE_DAILY
from ..operators import findings as FS
from ..operators import guards as G
from ..operators import versioned as V
from ..operators.partitioned import PartitionedVersions
from ..plans import reports, rules, scenes
from ..session import cut_lineage, scratch_path
from .base import BATCHES, DAILY_PRICE, price_points_sql, query

VERSIONS = f"""WITH b AS ({BATCHES}), l AS (SELECT *, LAG(value) OVER w AS pv, ROW_NUMBER() OVER w AS rn FROM b WINDOW w AS (PARTITION BY series_id ORDER BY batch)),
 k AS (SELECT * FROM l WHERE rn = 1 OR abs(pv - value) > 1e-9 * GREATEST(1, abs(pv))),
 v AS (SELECT *, ROW_NUMBER() OVER w AS revision_no, LEAD(batch) OVER w AS closed FROM k WINDOW w AS (PARTITION BY series_id ORDER BY batch))"""


def _versions(spark, folder):
    return V.versions_from_batches(B.batches(spark, folder), "seen_at")


def _batch_no(c):
    return ((F.unix_timestamp(c) - 946_684_800) / 86_400).cast("bigint")


@query("scd2_merge_versions", VERSIONS + """ SELECT series_id, revision_no, value, batch AS first_batch, closed AS closed_by_batch,
 CAST(closed IS NULL AS INTEGER) AS is_current FROM v""")
def scd2_merge_versions(spark, folder):
    v = _versions(spark, folder)
    return v.select("series_id", F.col("revision_no").cast("bigint").alias("revision_no"), "value", _batch_no(F.col("first_seen_at")).alias("first_batch"),
                    _batch_no(F.col("superseded_at")).alias("closed_by_batch"), F.col("is_current").cast("int").alias("is_current"))


def _store_before_and_batch(spark, folder):
    """The store as it stood after the earlier batches, and one incoming batch: the newest row of every order."""
    b = B.batches(spark, folder)
    last = b.groupBy("series_id").agg(F.max("batch").alias("_m"))
    marked = b.join(last, "series_id")
    stored = V.versions_from_batches(marked.where("batch < _m").drop("_m"), "seen_at").select(*V.COLUMNS)
    incoming = marked.where("batch = _m").select("series_id", "obs_start", "value")
    return stored, incoming


@query("scd2_incremental_merge", VERSIONS + """, m AS (SELECT series_id, MAX(batch) AS mb FROM b GROUP BY 1)
 SELECT series_id, COUNT(*) AS n_versions, MAX(revision_no) AS last_revision, arg_max(value, revision_no) AS current_value,
 COUNT(*) FILTER (WHERE closed IS NULL) AS n_current FROM v GROUP BY 1""")
def scd2_incremental_merge(spark, folder):
    stored, incoming = _store_before_and_batch(spark, folder)
    store = PartitionedVersions(spark, scratch_path(spark, "observations"), 8)
    store.load(stored)
    store.merge_batch(1, incoming, F.timestamp_seconds(F.lit(978_307_200)))
    return store.read().groupBy("series_id").agg(
        F.count("*").alias("n_versions"), F.max("revision_no").cast("bigint").alias("last_revision"),
        F.max_by("value", "revision_no").alias("current_value"), F.count_if("is_current").alias("n_current"))


@query("merge_counts", VERSIONS + """, m AS (SELECT series_id, MAX(batch) AS mb, COUNT(*) AS nb FROM b GROUP BY 1),
 j AS (SELECT m.*, EXISTS (SELECT 1 FROM k WHERE k.series_id = m.series_id AND k.batch = m.mb) AS kept FROM m)
 SELECT COUNT(*) FILTER (WHERE nb = 1) AS n_new, COUNT(*) FILTER (WHERE nb > 1 AND kept) AS n_revised, COUNT(*) FILTER (WHERE nb > 1 AND NOT kept) AS n_unchanged FROM j""")
def merge_counts(spark, folder):
    stored, incoming = _store_before_and_batch(spark, folder)
    _, counts = V.merge_observations(stored, incoming, F.timestamp_seconds(F.lit(978_307_200)))
    return counts.agg(*[F.sum(c).alias(c) for c in ("n_new", "n_revised", "n_unchanged")])


@query("vintage_as_of", VERSIONS + """ SELECT series_id, revision_no, value FROM v WHERE batch <= 3 AND (closed IS NULL OR closed > 3)""")
def vintage_as_of(spark, folder):
    o = V.observations(_versions(spark, folder), F.timestamp_seconds(F.lit(946_684_800 + 3 * 86_400)))
    return o.select("series_id", F.col("revision_no").cast("bigint").alias("revision_no"), "value")


def _stored(spark, findings):
    extra = {"anomaly_id": "string", "status": "string", "created_at": "timestamp", "as_of": "timestamp", "superseded_at": "timestamp",
             "superseded_by": "string", "continuation_of": "string"}
    empty = findings.where(F.lit(False))
    for c, t in extra.items():
        empty = empty.withColumn(c, F.lit(None).cast(t))
    return empty


@query("finding_supersession", price_points_sql(DAILY_PRICE, 250, 60, 5, 4.0, 2.0) + """,
 a AS (SELECT series_id, obs_start, fired, severity, CASE WHEN fired AND date_diff('day', LAG(obs_start) OVER w, obs_start) <= 3 THEN 1 ELSE 0 END AS cont
   FROM points WINDOW w AS (PARTITION BY series_id, fired ORDER BY obs_start)),
 x AS (SELECT series_id, 'active' AS status, COUNT(*) AS n, SUM(CAST(fired AS INTEGER)) AS n_fired, SUM(cont) AS n_continuations FROM a GROUP BY 1
   UNION ALL SELECT series_id, 'superseded', COUNT(*), SUM(CAST(fired AS INTEGER)), SUM(cont) FROM a WHERE series_id = 'orders.2-HIGH' GROUP BY 1)
 SELECT series_id, status, n, CAST(n_fired AS BIGINT) AS n_fired, CAST(n_continuations AS BIGINT) AS n_continuations FROM x""")
def finding_supersession(spark, folder):
    """Screen, store, then screen again after one series was revised throughout: its findings are replaced."""
    # Both screenings read the same findings: computed once and kept in the shared folder.
    f1 = cut_lineage(rules.price_rule(B.daily_price(spark, folder), {**PRICE_DAILY, "last_n": None}, z_threshold=2.0))
    revised = F.col("series_id") == "orders.2-HIGH"
    f2 = f1.withColumn("input_version_ids", F.when(revised, F.transform("input_version_ids", lambda v: F.concat(v, F.lit("#2")))
                                                   ).otherwise(F.col("input_version_ids")))
    now = F.lit("2002-01-01").cast("timestamp")
    first = FS.store_findings(_stored(spark, f1), f1, now)
    second = FS.store_findings(first, f2, F.lit("2002-01-02").cast("timestamp"))
    return second.groupBy("series_id", "status").agg(
        F.count("*").alias("n"), F.count_if("fired").alias("n_fired"), F.count("continuation_of").alias("n_continuations"))


CARDS = """WITH c AS (SELECT o_custkey AS card_id, year(o_orderdate) AS build, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS done, COUNT(DISTINCT o_orderpriority) AS kinds
   FROM orders GROUP BY 1, 2), l AS (SELECT *, LAG(done) OVER w AS pd, LAG(kinds) OVER w AS pk, ROW_NUMBER() OVER w AS rn FROM c WINDOW w AS (PARTITION BY card_id ORDER BY build)),
 k AS (SELECT * FROM l WHERE rn = 1 OR done <> pd OR kinds <> pk),
 v AS (SELECT card_id, build, done, kinds, ROW_NUMBER() OVER w AS version, LEAD(build) OVER w AS nxt FROM k WINDOW w AS (PARTITION BY card_id ORDER BY build))"""


def _card_builds(spark, folder):
    o = B.table(spark, folder, "orders")
    return o.groupBy(F.col("o_custkey").alias("card_id"), F.year("o_orderdate").alias("build")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_distinct("o_orderpriority").alias("kinds"))


@query("content_versioned_cards", CARDS + " SELECT card_id, build, done, kinds, version, CASE WHEN nxt IS NULL THEN 'current' ELSE 'superseded' END AS status FROM v")
def content_versioned_cards(spark, folder):
    h = FS.card_history(_card_builds(spark, folder), "build", ["done", "kinds"])
    return h.select("card_id", F.col("build").cast("bigint").alias("build"), "done", "kinds", F.col("version").cast("bigint").alias("version"), "status")


@query("card_store_merge", CARDS + """, b AS (SELECT * FROM c WHERE build = 2000), p AS (SELECT * FROM c WHERE build = 1999)
 SELECT COALESCE(b.card_id, p.card_id) AS card_id, CASE WHEN b.card_id IS NULL THEN 'withdrawn' ELSE 'current' END AS status,
 CASE WHEN p.card_id IS NULL OR b.card_id IS NULL OR (b.done = p.done AND b.kinds = p.kinds) THEN 1 ELSE 2 END AS version FROM b FULL JOIN p ON b.card_id = p.card_id
 UNION ALL SELECT p.card_id, 'superseded', 1 FROM p JOIN b ON b.card_id = p.card_id AND NOT (b.done = p.done AND b.kinds = p.kinds)""")
def card_store_merge(spark, folder):
    """Two builds in a row: the cards of 1999 are stored, the cards of 2000 arrive."""
    c = _card_builds(spark, folder).withColumn("kind", F.lit("anomaly"))
    empty = spark.createDataFrame([], "card_id bigint, version int, kind string, status string, created_at timestamp, content_hash string")
    first = FS.store_cards(empty, c.where("build = 1999"), ["done", "kinds"], F.lit("2000-01-01").cast("timestamp"), ["anomaly"])
    second = FS.store_cards(first, c.where("build = 2000"), ["done", "kinds"], F.lit("2001-01-01").cast("timestamp"), ["anomaly"])
    return second.select("card_id", "status", F.col("version").cast("bigint").alias("version"))


@query("upsert_keep_nonempty", """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 0 THEN 'title ' || l.quality ELSE d.lang END AS title,
 CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE d.n_chars END AS n, LEAST(d.doc_id + 5, COALESCE(l.doc_id + 3, d.doc_id + 5)) AS seen, d.source AS source
 FROM documents d LEFT JOIN labels l USING (doc_id)""")
def upsert_keep_nonempty(spark, folder):
    d = B.table(spark, folder, "documents").select("doc_id", F.col("lang").alias("title"), F.col("n_chars").alias("n"),
                                                   (F.col("doc_id") + 5).alias("seen"), "source")
    lab = B.table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("title "), F.col("quality").cast("string"))).alias("title"),
        F.col("quality").cast("bigint").alias("n"), (F.col("doc_id") + 3).alias("seen"), F.lit("label").alias("source"))
    return V.upsert_latest(d, lab, ["doc_id"], overwrite=["n"], keep_when_empty=["title"], earliest=["seen"])


def _views_and_rest(spark, folder):
    """A user's views of a day, and one row for everything else of that day."""
    e = B.table(spark, folder, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.min("value").alias("v"))
    rest = e.where("event_type <> 'view'").groupBy("user_id", "day").agg(F.min("event_type").alias("event_type"), F.min("v").alias("v"))
    return e.where("event_type = 'view'"), rest


@query("insert_if_absent", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, MIN(value) AS v FROM events GROUP BY 1, 2, 3), c AS (SELECT * FROM e WHERE event_type = 'view'),
 n AS (SELECT user_id, day, MIN(event_type) AS event_type, MIN(v) AS v FROM e WHERE event_type <> 'view' GROUP BY 1, 2) SELECT user_id, CAST(day AS VARCHAR) AS day, event_type, v FROM c UNION ALL
 SELECT user_id, CAST(day AS VARCHAR), event_type, v FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = n.user_id AND c.day = n.day)""")
def insert_if_absent(spark, folder):
    return V.insert_if_absent(*_views_and_rest(spark, folder), ["user_id", "day"])


@query("replace_by_key", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, MIN(value) AS v FROM events GROUP BY 1, 2, 3), c AS (SELECT * FROM e WHERE event_type = 'view'),
 n AS (SELECT user_id, day, MIN(event_type) AS event_type, MIN(v) AS v FROM e WHERE event_type <> 'view' GROUP BY 1, 2) SELECT user_id, CAST(day AS VARCHAR) AS day, event_type, v FROM n UNION ALL
 SELECT user_id, CAST(day AS VARCHAR), event_type, v FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE c.user_id = n.user_id AND c.day = n.day)""")
def replace_by_key(spark, folder):
    return V.replace_by_key(*_views_and_rest(spark, folder), ["user_id", "day"])


@query("update_if_newer", """WITH o AS (SELECT o_custkey, MAX(o_orderkey) AS stamp, MAX(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
 n AS (SELECT o_custkey, MAX(o_orderkey) AS stamp, MAX(o_totalprice) AS price FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
 SELECT COALESCE(o.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN o.o_custkey IS NULL OR n.stamp > o.stamp THEN n.stamp ELSE o.stamp END AS stamp,
 CASE WHEN o.o_custkey IS NULL OR n.stamp > o.stamp THEN n.price ELSE o.price END AS price FROM o FULL JOIN n ON o.o_custkey = n.o_custkey""")
def update_if_newer(spark, folder):
    o = B.table(spark, folder, "orders")

    def side(s):
        return o.where(s).groupBy("o_custkey").agg(F.max("o_orderkey").alias("stamp"), F.max("o_totalprice").alias("price"))
    return V.update_if_newer(side("o_orderstatus = 'F'"), side("o_orderstatus <> 'F'"), ["o_custkey"], "stamp", ["price"])


@query("provenance", price_points_sql(DAILY_PRICE, 250, 60, 5, 4.0, 2.0) + """, i AS (SELECT series_id, obs_start, obs_start AS used FROM points WHERE fired
   UNION ALL SELECT series_id, obs_start, pd FROM points WHERE fired)
 SELECT i.series_id, CAST(i.obs_start AS VARCHAR) AS obs_start, CAST(i.used AS VARCHAR) AS used_day, ROUND(s.value + 1e-9, 4) AS used_value FROM i JOIN s ON s.series_id = i.series_id AND s.obs_start = i.used""")
def provenance(spark, folder):
    obs = B.daily_price(spark, folder)
    f = rules.price_rule(obs, {**PRICE_DAILY, "last_n": None}, z_threshold=2.0).where("fired")
    f = f.withColumn("anomaly_id", F.concat_ws("|", "series_id", F.col("obs_start").cast("string")))
    raw = spark.createDataFrame([], "sha256 string, url string, retrieved_at timestamp")
    v = obs.withColumns({"revision_no": F.lit(1), "raw_sha256": F.lit(None).cast("string")})
    p = reports.provenance(f, v, raw)
    parts = F.split("anomaly_id", r"\|")
    return p.select("series_id", F.get(parts, 1).alias("obs_start"), F.col("obs_start").cast("string").alias("used_day"), F.round(F.col("value") + 1e-9, 4).alias("used_value"))


@query("run_statistics", """SELECT 'src' || (user_id % 10) AS source, COUNT(*) AS runs, COUNT(*) FILTER (WHERE event_type <> 'error') AS ok_runs,
 CAST(CAST(MAX(ts) AS DATE) AS VARCHAR) AS last_day FROM events GROUP BY 1""")
def run_statistics(spark, folder):
    r = reports.run_statistics(_runs(spark, folder))
    return r.select("source", "runs", "ok_runs", F.to_date("last_run").cast("string").alias("last_day"))


def _runs(spark, folder):
    e = B.table(spark, folder, "events")
    return e.select(F.concat(F.lit("src"), F.pmod("user_id", F.lit(10)).cast("string")).alias("source"),
                    F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("ts").alias("finished_at"))


@query("freshness_report", """WITH r AS (SELECT 'src' || (user_id % 10) AS source, COUNT(*) AS runs, CAST(MAX(ts) AS DATE) AS latest FROM events GROUP BY 1)
 SELECT source, runs, date_diff('day', latest, DATE '2024-02-06') AS age_days, CAST(date_diff('day', latest, DATE '2024-02-06') > 7 AS INTEGER) AS stale FROM r""")
def freshness_report(spark, folder):
    latest = B.table(spark, folder, "events").groupBy(F.concat(F.lit("src"), F.pmod("user_id", F.lit(10)).cast("string")).alias("source")).agg(
        F.to_date(F.max("ts")).alias("latest_observation")).withColumn("frequency", F.lit("daily"))
    r = reports.freshness_report(latest, _runs(spark, folder), F.lit("2024-02-06").cast("date"))
    return r.select("source", "runs", F.col("age_days").cast("bigint").alias("age_days"), F.col("stale").cast("int").alias("stale"))


@query("changes_since", VERSIONS + """ SELECT o_orderpriority AS name, COUNT(*) FILTER (WHERE revision_no = 1) AS n_new, COUNT(*) FILTER (WHERE revision_no > 1) AS n_revised
 FROM v JOIN orders ON 'order.' || o_orderkey = series_id WHERE batch > 2 GROUP BY 1""")
def changes_since(spark, folder):
    since = F.timestamp_seconds(F.lit(946_684_800 + 2 * 86_400))
    v = _versions(spark, folder)
    names = B.table(spark, folder, "orders").select(F.concat(F.lit("order."), F.col("o_orderkey").cast("string")).alias("series_id"), F.col("o_orderpriority").alias("name"))
    new = reports.new_measurements(v, names, since).groupBy("name").agg(F.sum("n_new").alias("n_new"))
    rev = v.where((F.col("first_seen_at") > since) & (F.col("revision_no") > 1)).join(names, "series_id").groupBy("name").agg(F.count("*").alias("n_revised"))
    return new.join(rev, "name", "full_outer").select("name", F.coalesce("n_new", F.lit(0)).alias("n_new"), F.coalesce("n_revised", F.lit(0)).alias("n_revised"))


@query("newest_revisions", VERSIONS + """ SELECT o_orderpriority AS name, series_id, revision_no, value, batch FROM v JOIN orders ON 'order.' || o_orderkey = series_id
 WHERE batch > 2 AND revision_no > 1 ORDER BY batch DESC, series_id LIMIT 200""")
def newest_revisions(spark, folder):
    since = F.timestamp_seconds(F.lit(946_684_800 + 2 * 86_400))
    names = B.table(spark, folder, "orders").select(F.concat(F.lit("order."), F.col("o_orderkey").cast("string")).alias("series_id"), F.col("o_orderpriority").alias("name"))
    r = reports.revisions_since(_versions(spark, folder), names, since, 200)
    return r.select("name", "series_id", F.col("revision_no").cast("bigint").alias("revision_no"), "value", _batch_no(F.col("first_seen_at")).alias("batch"))


@query("review_decisions", """SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'confirmed' ELSE 'unreviewed' END AS review_status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def review_decisions(spark, folder):
    d = B.table(spark, folder, "documents").select("doc_id", F.lit("unreviewed").alias("review_status"))
    lab = B.table(spark, folder, "labels").select("doc_id", F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "confirmed").alias("decision"))
    return V.apply_decisions(d, lab, "doc_id", "review_status")


@query("reviewed_precision", """WITH s AS (SELECT d.lang, CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'confirmed' ELSE 'unreviewed' END AS st FROM documents d LEFT JOIN labels l USING (doc_id))
 SELECT lang, COUNT(*) FILTER (WHERE st = 'confirmed') AS confirmed, COUNT(*) FILTER (WHERE st = 'rejected') AS rejected,
 ROUND(COUNT(*) FILTER (WHERE st = 'confirmed') / NULLIF(COUNT(*) FILTER (WHERE st IN ('confirmed', 'rejected')), 0), 6) AS precision FROM s GROUP BY 1""")
def reviewed_precision(spark, folder):
    s = review_decisions(spark, folder).join(B.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    p = scenes.precision_report(s, "review_status", ["lang"])
    return p.select("lang", "confirmed", "rejected", F.round("precision", 6).alias("precision"))


@query("cards_with_review", CARDS + """, r AS (SELECT card_id, MAX(version) AS version FROM v GROUP BY 1) SELECT r.card_id, r.version, COALESCE(CASE WHEN l.quality = 1 THEN 'keep' ELSE 'dismissed' END, 'open') AS decision,
 CAST(COALESCE(1 < r.version AND l.doc_id IS NOT NULL, FALSE) AS INTEGER) AS updated_since_review FROM r LEFT JOIN labels l ON l.doc_id = r.card_id
 """.replace("COALESCE(CASE WHEN l.quality = 1 THEN 'keep' ELSE 'dismissed' END, 'open')", "CASE WHEN l.doc_id IS NULL THEN 'open' WHEN l.quality = 1 THEN 'keep' ELSE 'dismissed' END"))
def cards_with_review(spark, folder):
    h = FS.card_history(_card_builds(spark, folder), "build", ["done", "kinds"]).where("status = 'current'")
    lab = B.table(spark, folder, "labels").select(F.col("doc_id").alias("card_id"), F.when(F.col("quality") == 1, "keep").otherwise("dismissed").alias("decision"),
                                                  F.lit(False).alias("pinned"), F.lit(1).alias("reviewed_version"))
    c = reports.with_review(h, lab)
    return c.select("card_id", F.col("version").cast("bigint").alias("version"), "decision", F.col("updated_since_review").cast("int").alias("updated_since_review"))


@query("review_store", """WITH e AS (SELECT user_id AS card_id, ts, event_id, event_id % 5 AS version, CASE WHEN event_type = 'click' THEN CASE WHEN value > 50 THEN 'dismissed' ELSE 'keep' END END AS decision,
  CASE WHEN event_type = 'purchase' THEN value > 40 END AS pinned, CASE WHEN event_type = 'error' THEN 'note ' || event_id END AS note FROM events),
 r AS (SELECT card_id, arg_max(decision, (ts, event_id)) FILTER (WHERE decision IS NOT NULL) AS decision, arg_max(note, (ts, event_id)) FILTER (WHERE note IS NOT NULL) AS note,
  arg_max(pinned, (ts, event_id)) FILTER (WHERE pinned IS NOT NULL) AS pinned, arg_max(version, (ts, event_id)) AS reviewed_version FROM e GROUP BY 1)
 SELECT c.c_custkey AS card_id, coalesce(r.decision, 'open') AS decision, r.note, coalesce(r.pinned, FALSE) AS pinned, CAST(r.reviewed_version AS INTEGER) AS reviewed_version, coalesce(r.reviewed_version < 3, FALSE) AS updated_since_review,
  concat_ws(',', CASE WHEN coalesce(r.decision, '') <> 'dismissed' THEN 'open' END, CASE WHEN r.pinned THEN 'pinned' END, CASE WHEN r.decision = 'dismissed' THEN 'dismissed' END, 'all') AS shown_under
 FROM customer c LEFT JOIN r ON r.card_id = c.c_custkey""")
def review_store(spark, folder):
    """Customers as cards of version 3, events as review entries that set one field each."""
    e, kind = B.table(spark, folder, "events"), F.col("event_type")
    log = e.select(F.col("user_id").alias("card_id"), "ts", "event_id", F.pmod("event_id", F.lit(5)).cast("int").alias("version"),
                   F.when(kind == "click", F.when(F.col("value") > 50, "dismissed").otherwise("keep")).alias("decision"), F.when(kind == "purchase", F.col("value") > 40).alias("pinned"),
                   F.when(kind == "error", F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("note"))
    cards = B.table(spark, folder, "customer").select(F.col("c_custkey").alias("card_id"), F.lit(3).alias("version"))
    state = reports.review_state(log, "ts", "event_id")
    c = reports.with_review(cards, state).join(state.select("card_id", "note"), "card_id", "left")
    shown = F.concat_ws(",", *[F.when(reports.shown_under(f), f) for f in reports.REVIEW_FILTERS])
    return c.select("card_id", "decision", "note", "pinned", "reviewed_version", "updated_since_review", shown.alias("shown_under"))


@query("unit_guard", """WITH d AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'USD per barrel' WHEN 'N' THEN 'percent' ELSE 'thousand barrels' END AS unit,
  CASE WHEN l_linenumber = 7 THEN '$/GAL' WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN '%' WHEN l_returnflag = 'A' THEN '$/BBL' WHEN l_returnflag = 'N' THEN 'PERCENT' WHEN l_linestatus = 'F' THEN 'MBBL' END AS provider FROM lineitem)
 SELECT 'unit' AS guard, unit AS item, provider AS detail, CAST(COUNT(*) AS DOUBLE) AS n FROM d WHERE l_linenumber = 7 GROUP BY 1, 2, 3
 UNION ALL SELECT 'magnitude', l_returnflag || l_linestatus, CAST(l_linenumber AS VARCHAR), MEDIAN(l_quantity) FROM lineitem GROUP BY 1, 2, 3 HAVING MEDIAN(l_quantity) NOT BETWEEN 25 AND 26
 UNION ALL SELECT 'total', CAST(declared AS VARCHAR), CAST(n_read AS VARCHAR), CAST(COUNT(*) AS DOUBLE) FROM (SELECT l_orderkey, MAX(l_linenumber) AS declared, COUNT(*) AS n_read FROM lineitem GROUP BY 1) WHERE declared <> n_read GROUP BY 1, 2, 3""")
def unit_guard(spark, folder):
    """Violations of the unit, magnitude and completeness guards among line items, counted."""
    d, flag, line = B.table(spark, folder, "lineitem"), F.col("l_returnflag"), F.col("l_linenumber")
    unit = F.when(flag == "A", "USD per barrel").when(flag == "N", "percent").otherwise("thousand barrels")
    said = (F.when(line == 7, "$/GAL").when((F.col("l_linestatus") == "O") & (flag == "N"), "%").when(flag == "A", "$/BBL").when(flag == "N", "PERCENT").when(F.col("l_linestatus") == "F", "MBBL"))
    units = G.unit_violations(d.select(unit.alias("unit"), said.alias("provider")), "unit", "provider").groupBy("unit", "provider").agg(F.count("*").cast("double").alias("n"))
    medians = G.magnitude_violations(d, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity", 25, 26)
    totals = G.total_violations(d.withColumn("one", F.lit(1)), ["l_orderkey"], "l_linenumber", "one").groupBy("declared", "read").agg(F.count("*").cast("double").alias("n"))
    return (units.select(F.lit("unit").alias("guard"), F.col("unit").alias("item"), F.col("provider").alias("detail"), "n")
            .unionByName(medians.select(F.lit("magnitude").alias("guard"), F.concat("l_returnflag", "l_linestatus").alias("item"), F.col("l_linenumber").cast("string").alias("detail"), F.col("median").alias("n")))
            .unionByName(totals.select(F.lit("total").alias("guard"), F.col("declared").cast("string").alias("item"), F.col("read").cast("string").alias("detail"), "n")))


@query("batch_guards", """WITH k AS (SELECT l_shipdate AS day, l_orderkey, l_linenumber, l_partkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_quantity >= 50 AND l_discount >= 0.1) AS bad, COUNT(*) FILTER (WHERE l_linenumber = 7) AS late
   FROM lineitem GROUP BY 1, 2, 3, 4),
 g AS (SELECT day, CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) FILTER (WHERE n > 1) AS n_repeated, CAST(SUM(bad) AS BIGINT) AS bad_discount, SUM(late) AS late FROM k GROUP BY 1)
 SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, n_rows, n_repeated, bad_discount, CASE WHEN bad_discount > 0 OR n_repeated > 0 THEN 'schema_changed' WHEN late = 0 THEN 'not_modified' ELSE 'ok' END AS status FROM g""")
def batch_guards(spark, folder):
    """Line items of a day as a batch; the last time each day was read, its seventh lines were not there yet."""
    d, mark = B.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    key, by = ["l_orderkey", "l_linenumber", "l_partkey"], ["l_shipdate"]
    before = G.batch_report(d.where("l_linenumber <> 7"), by, key, {}, mark=mark)
    r = G.batch_report(d, by, key, {"discount": (F.col("l_quantity") < 50) | (F.col("l_discount") < 0.1)}, before, mark)
    return r.select(F.to_date("l_shipdate").cast("string").alias("day"), "n_rows", "n_repeated", "bad_discount", "status")


@query("card_build", """WITH c AS (SELECT o_custkey AS card_id, year(o_orderdate) AS build, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS done, COUNT(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1, 2),
 k AS (SELECT *, CASE card_id % 3 WHEN 0 THEN 'anomaly' WHEN 1 THEN 'headline' ELSE 'context' END AS kind, card_id % 3 = 0 OR (card_id % 3 = 1 AND card_id % 2 = 0) AS leaves FROM c),
 l AS (SELECT *, LAG(done) OVER w AS pd, LAG(kinds) OVER w AS pk, LAG(build) OVER w AS pb, MAX(build) OVER (PARTITION BY card_id) AS last FROM k WINDOW w AS (PARTITION BY card_id ORDER BY build)),
 s AS (SELECT *, leaves AND build - pb > 1 AS came_back FROM l WHERE pb IS NULL OR done <> pd OR kinds <> pk OR (leaves AND build - pb > 1)),
 v AS (SELECT *, ROW_NUMBER() OVER w AS version, LEAD(came_back) OVER w AS next_came_back, LEAD(build) OVER w AS nb FROM s WINDOW w AS (PARTITION BY card_id ORDER BY build))
 SELECT card_id, kind, version, build, done, kinds, CASE WHEN nb IS NOT NULL THEN CASE WHEN next_came_back THEN 'withdrawn' ELSE 'superseded' END
  WHEN leaves AND last < (SELECT MAX(build) FROM c) THEN 'withdrawn' ELSE 'current' END AS status FROM v""")
def card_build(spark, folder):
    """One build of all kinds per year of orders: a customer's card is produced in years with orders. Anomaly cards are always
    all produced, of the headline cards every second is looked at, context cards are never withdrawn."""
    which = F.element_at(F.array(*map(F.lit, ("anomaly", "headline", "context"))), (F.pmod("card_id", F.lit(3)) + 1).cast("int"))
    c = cut_lineage(_card_builds(spark, folder).withColumn("kind", which))
    table = spark.createDataFrame([], "card_id bigint, version int, kind string, status string, created_at timestamp, content_hash string, done bigint, kinds bigint, build int")
    looked_at = c.where("kind = 'headline' AND card_id % 2 = 0").select("card_id").distinct()
    for year in [r[0] for r in c.select("build").distinct().sort("build").collect()]:
        table, _ = FS.build_cards(table, c.where(F.col("build") == year), ["done", "kinds"], F.make_timestamp(F.lit(year), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)), ["anomaly"], looked_at)
        table = cut_lineage(table)
    return table.select("card_id", "kind", F.col("version").cast("bigint").alias("version"), F.col("build").cast("bigint").alias("build"), "done", "kinds", "status")
