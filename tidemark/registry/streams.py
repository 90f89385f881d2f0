"""Streaming queries (run over what is there) and their batch twins; JSON decoding and code tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..functions.codes import flag_state, nav_status_text, ship_class, ship_type_text
from ..functions.numbers import in_range
from ..session import scratch_path
from ..sources.jsonstat import decode_jsonstat
from ..streaming import feeds, vessel_state, vessels
from .base import query
from .stores import VERSIONS


def _events_stream(spark, folder):
    schema = B.table(spark, folder, "events").schema
    return feeds.landing(spark, folder, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _messages(events):
    """Events as vessel messages in JSON text: positions from most types, static data from sign-ups."""
    mmsi = F.col("user_id") + 211_000_000
    lat = F.when(F.col("event_type") == "error", 91.0).otherwise(F.pmod("event_id", F.lit(1700)) / 10.0 - 85.0)
    pos = F.struct(F.lit("PositionReport").alias("MessageType"), F.struct(mmsi.alias("MMSI"), F.lit(None).cast("string").alias("ShipName")).alias("MetaData"), F.struct(F.struct(
        lat.alias("Latitude"), (F.pmod("event_id", F.lit(3500)) / 10.0 - 175.0).alias("Longitude"), F.col("value").alias("Sog"), F.lit(360).alias("Cog"),
        F.lit(511).alias("TrueHeading"), F.pmod("event_id", F.lit(9)).cast("int").alias("NavigationalStatus")).alias("PositionReport")).alias("Message"))
    static = F.struct(F.lit("ShipStaticData").alias("MessageType"), F.struct(mmsi.alias("MMSI")).alias("MetaData"), F.struct(F.struct(
        F.when(F.pmod("event_id", F.lit(3)) == 0, "").otherwise(F.concat(F.lit("<SHIP> "), F.col("user_id").cast("string"), F.lit("@@"))).alias("Name"),
        F.pmod("event_id", F.lit(100)).cast("int").alias("Type"), F.concat(F.lit("PORT "), F.pmod("event_id", F.lit(7)).cast("string")).alias("Destination"),
        F.pmod("value", F.lit(31.0)).alias("MaximumStaticDraught")).alias("ShipStaticData")).alias("Message"))
    return events.select("event_id", "ts", F.when(F.col("event_type") == "signup", F.to_json(static)).otherwise(F.to_json(pos)).alias("value"))


def _parsed(events):
    raw = _messages(events)
    # The event number is unique per instant; it rides along in the time order.
    return vessels.parse_messages(raw.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("k", F.unix_micros("ts"))


VESSELS = """WITH e AS (SELECT user_id + 211000000 AS mmsi, ts, event_id, event_type, value FROM events),
 p AS (SELECT *, ROUND(CAST(event_id % 1700 AS DOUBLE) / 10.0::DOUBLE - 85.0::DOUBLE, 5) AS lat, ROUND(CAST(event_id % 3500 AS DOUBLE) / 10.0::DOUBLE - 175.0::DOUBLE, 5) AS lon FROM e WHERE event_type NOT IN ('signup', 'error')),
 lp AS (SELECT * FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY mmsi ORDER BY ts DESC) = 1),
 st AS (SELECT *, event_id % 100 AS type FROM e WHERE event_type = 'signup' QUALIFY ROW_NUMBER() OVER (PARTITION BY mmsi ORDER BY ts DESC) = 1),
 nm AS (SELECT mmsi, 'SHIP ' || (mmsi - 211000000) AS name FROM e WHERE event_type = 'signup' AND event_id % 3 <> 0 GROUP BY 1),
 tr AS (SELECT mmsi, LEAST(60, COUNT(*)) AS n FROM (SELECT *, LAG(lat) OVER w AS pl, LAG(lon) OVER w AS po FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY ts)) WHERE pl IS NULL OR pl <> lat OR po <> lon GROUP BY 1)"""


@query("vessel_state_batch", VESSELS + """ SELECT lp.mmsi, nm.name, lp.lat, lp.lon, CASE WHEN lp.value = 102.3 OR lp.value < 0 OR lp.value > 102.2 THEN NULL ELSE lp.value END AS sog, CAST(st.type AS INTEGER) AS type,
 CASE WHEN st.type IS NULL THEN 'unknown' WHEN st.type BETWEEN 80 AND 89 THEN 'tanker' WHEN st.type BETWEEN 70 AND 79 THEN 'cargo' WHEN st.type BETWEEN 60 AND 69 THEN 'passenger' WHEN st.type = 30 THEN 'fishing'
 WHEN st.type IN (31,32,33,34,50,51,52,53,54,55,58,59) THEN 'service' WHEN st.type = 35 THEN 'military' WHEN st.type IN (36,37) THEN 'leisure' WHEN st.type BETWEEN 40 AND 49 THEN 'high_speed' ELSE 'other' END AS ship_class,
 CASE WHEN st.type IS NOT NULL THEN 'PORT ' || (st.event_id % 7) END AS destination, tr.n AS track_points
 FROM lp LEFT JOIN st USING (mmsi) LEFT JOIN nm USING (mmsi) JOIN tr USING (mmsi) WHERE epoch(TIMESTAMP '2024-01-31') - floor(epoch(lp.ts)) <= 259200""")
def vessel_state_batch(spark, folder):
    m = _parsed(B.table(spark, folder, "events"))
    s = vessels.snapshot(vessels.latest_state(m), F.lit("2024-01-31").cast("timestamp"), 259_200).join(vessels.tracks(m, "k"), "mmsi")
    return s.select("mmsi", "name", "lat", "lon", "sog", "type", "ship_class", "destination", F.size("track").cast("bigint").alias("track_points"))


@query("vessel_state_stream", VESSELS + """ SELECT lp.mmsi, nm.name, lp.lat, lp.lon, tr.n AS track_points FROM lp LEFT JOIN nm USING (mmsi) JOIN tr USING (mmsi)""")
def vessel_state_stream(spark, folder):
    m = _parsed(_events_stream(spark, folder))
    out = feeds.run_available(vessels.track_stream(m, stale_after_s=5_184_000), "update", "vessels")
    last = out.where("NOT expired").groupBy("mmsi").agg(F.max_by(F.struct("name", "lat", "lon", "track_lat"), "batch_id").alias("r"))
    return last.where("r.lat IS NOT NULL").select("mmsi", "r.name", "r.lat", "r.lon", F.size("r.track_lat").cast("bigint").alias("track_points"))


@query("vessel_latest_stream", VESSELS + """ SELECT lp.mmsi, nm.name, lp.lat, lp.lon FROM lp LEFT JOIN nm USING (mmsi)""")
def vessel_latest_stream(spark, folder):
    out = feeds.run_available(vessels.latest_state(_parsed(_events_stream(spark, folder))), "update", "vessel-latest")
    last = out.groupBy("mmsi").agg(F.max_by(F.struct("name", "lat", "lon"), "batch_id").alias("r"))
    return last.where("r.lat IS NOT NULL").select("mmsi", "r.*")


@query("vessel_expiry_stream", VESSELS + """, m AS (SELECT mmsi, COUNT(*) AS n, MAX(ts) FILTER (WHERE event_type = 'signup') AS static_at FROM e WHERE event_type <> 'error' GROUP BY 1),
 w AS (SELECT epoch_ms(MAX(ts)) - 600000 AS mark FROM e WHERE event_type <> 'error')
 SELECT m.mmsi, nm.name, lp.lat, lp.lon, CASE WHEN lp.value = 102.3 OR lp.value < 0 OR lp.value > 102.2 THEN NULL ELSE lp.value END AS sog, CAST(st.type AS INTEGER) AS type,
 CASE WHEN st.type IS NOT NULL THEN 'PORT ' || (st.event_id % 7) END AS destination, CASE WHEN st.value % 31 <> 0 AND st.value % 31 <= 30 THEN st.value % 31 END AS draught,
 epoch_us(lp.ts) AS position_us, epoch_us(m.static_at) AS static_us, m.n AS n_messages, COALESCE(tr.n, 0) AS track_points, epoch_ms(COALESCE(lp.ts, m.static_at)) + 86400000 <= w.mark AS expired
 FROM m LEFT JOIN lp USING (mmsi) LEFT JOIN st USING (mmsi) LEFT JOIN nm USING (mmsi) LEFT JOIN tr USING (mmsi), w""")
def vessel_expiry_stream(spark, folder):
    """The last state of every vessel, and whether its timer ran out: silent for a day when the stream's watermark ends."""
    out = feeds.run_available(vessel_state.vessel_states(_parsed(_events_stream(spark, folder)), 86_400), "update", "vessel-expiry")
    last = out.groupBy("mmsi").agg(F.max_by(F.struct(*[c for c in out.columns if c != "mmsi"]), F.struct("batch_id", "expired")).alias("r")).select("mmsi", "r.*")
    return last.select("mmsi", "name", "lat", "lon", "sog", "type", "destination", "draught", F.unix_micros("position_at").alias("position_us"), F.unix_micros("static_at").alias("static_us"),
                       "n_messages", F.size("track_lat").cast("bigint").alias("track_points"), "expired")


@query("completed_days_stream", """WITH r AS (SELECT ts + INTERVAL 1 HOUR AS t, event_type, value FROM events), g AS (SELECT CAST(t AS DATE) AS day, event_type, AVG(value) AS m, COUNT(value) AS n FROM r GROUP BY 1, 2)
 SELECT CAST(day AS VARCHAR) AS day, event_type, ROUND(m + 1e-9, 4) AS mean_value, n AS n_readings FROM g WHERE day + INTERVAL 1 DAY <= (SELECT MAX(t) - INTERVAL 2 HOUR FROM r)""")
def completed_days_stream(spark, folder):
    d = feeds.completed_days(_events_stream(spark, folder), "ts", "Europe/Berlin", ["event_type"], "value")
    out = feeds.run_available(d, "append", "days")
    return out.select(F.col("day").cast("string").alias("day"), "event_type", F.round(F.col("mean_value") + 1e-9, 4).alias("mean_value"), "n_readings")


@query("stream_sessions", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 n AS (SELECT *, SUM(st) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM s), g AS (SELECT user_id, no, MIN(ts) AS a, MAX(ts) AS b, COUNT(*) AS n FROM n GROUP BY 1, 2)
 SELECT user_id, epoch_us(a) AS start_us, epoch_us(b) AS end_us, n FROM g WHERE b + INTERVAL 1 HOUR <= (SELECT MAX(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_sessions(spark, folder):
    out = feeds.run_available(feeds.session_events(_events_stream(spark, folder), "ts", "user_id", "1 hour"), "append", "sessions")
    return out.select("user_id", F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"), "n")


@query("stream_dedupe", "SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events GROUP BY 1, 2, 3")
def stream_dedupe(spark, folder):
    d = _events_stream(spark, folder).select("user_id", "event_type", "ts", F.to_date("ts").cast("string").alias("day"))
    return feeds.run_available(feeds.first_arrivals(d, "ts", ["user_id", "event_type", "day"]), "append", "dedupe").select("user_id", "event_type", "day")


@query("stream_merge", VERSIONS + """ SELECT series_id, revision_no, value, batch AS first_batch, closed AS closed_by_batch FROM v""")
def stream_merge(spark, folder):
    schema = B.table(spark, folder, "lineitem").schema
    li = feeds.landing(spark, folder, schema, "lineitem.parquet")

    def rows(d):
        return d.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("value")).select(
            F.concat(F.lit("order."), F.col("l_orderkey").cast("string")).alias("series_id"), F.lit("2000-01-01").cast("date").alias("obs_start"), "value",
            F.timestamp_seconds(F.lit(946_684_800) + F.col("l_linenumber") * 86_400).alias("seen_at"))
    # The per-batch reduction happens inside the sink step, where a batch is an ordinary DataFrame.
    table = feeds.merge_stream(li, "seen_at", scratch_path(spark, "merge"), prepare=rows, buckets=8)
    no = lambda c: ((F.unix_timestamp(c) - 946_684_800) / 86_400).cast("bigint")
    return table.select("series_id", F.col("revision_no").cast("bigint").alias("revision_no"), "value", no(F.col("first_seen_at")).alias("first_batch"),
                        no(F.col("superseded_at")).alias("closed_by_batch"))


@query("stream_counters", "SELECT COUNT(*) AS n_messages, epoch_us(MAX(ts)) AS last_us FROM events")
def stream_counters(spark, folder):
    out = feeds.run_available(feeds.message_counts(_events_stream(spark, folder), "ts"), "update", "counters")
    return out.agg(F.max_by("n_messages", "batch_id").alias("n_messages"), F.unix_micros(F.max("last_message_at")).alias("last_us"))


@query("json_decode", "SELECT event_type, COUNT(*) AS n, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_decode(spark, folder):
    e = B.table(spark, folder, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("grid_decode", """WITH c AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, COUNT(*) AS v FROM events GROUP BY 1, 2, 3), u AS (SELECT user_id, MIN(day) AS d0, MAX(day) AS d1 FROM c GROUP BY 1),
 t AS (SELECT DISTINCT user_id, event_type FROM c), d AS (SELECT DISTINCT user_id, day FROM c) SELECT t.user_id, t.event_type, CAST(d.day AS VARCHAR) AS day, CAST(c.v AS DOUBLE) AS value FROM t JOIN d USING (user_id) LEFT JOIN c ON c.user_id = t.user_id AND c.event_type = t.event_type AND c.day = d.day""")
def grid_decode(spark, folder):
    """Event counts packed into one JSON-stat document per user, then decoded; absent cells are null."""
    return decode_jsonstat(grid_documents(B.table(spark, folder, "events")), "doc", ["type", "time"]).select(
        "user_id", F.col("type").alias("event_type"), F.col("time").alias("day"), "value")


def grid_documents(events):
    """One JSON-stat document per user. Decoding reads it more than once and knows it by its text, so the cells are sorted: a
    list in the order in which a shuffle delivers them would differ from one reading to the next."""
    c = events.groupBy("user_id", "event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("v"))
    g = c.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"), F.array_sort(F.collect_set("day")).alias("days"),
                                 F.array_sort(F.collect_list(F.struct("event_type", "day", "v"))).alias("cells"))

    def index(a):
        return F.map_from_arrays(a, F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: i))
    flat = F.map_from_entries(F.transform("cells", lambda x: F.struct(
        ((F.array_position("types", x["event_type"]) - 1) * F.size("days") + F.array_position("days", x["day"]) - 1).cast("string"), x["v"].cast("double"))))
    doc = F.to_json(F.struct(F.array(F.lit("type"), F.lit("time")).alias("id"), F.array(F.size("types"), F.size("days")).alias("size"), F.create_map(
        F.lit("type"), F.struct(F.struct(index(F.col("types")).alias("index")).alias("category")),
        F.lit("time"), F.struct(F.struct(index(F.col("days")).alias("index")).alias("category"))).alias("dimension"), flat.alias("value")))
    return g.select("user_id", doc.alias("doc"))


@query("sentinel_clean", """SELECT event_type, COUNT(*) AS n, COUNT(CASE WHEN value = 51.5 OR value < 10 OR value > 90 THEN NULL ELSE value END) AS n_valid FROM events GROUP BY 1""")
def sentinel_clean(spark, folder):
    e = B.table(spark, folder, "events").withColumn("v", in_range(F.col("value"), 51.5, 10, 90))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("v").alias("n_valid"))


@query("code_lookup", """WITH e AS (SELECT user_id, event_id % 100 AS t FROM events) SELECT t AS type, CASE WHEN t BETWEEN 80 AND 89 THEN 'tanker' WHEN t BETWEEN 70 AND 79 THEN 'cargo' WHEN t BETWEEN 60 AND 69 THEN 'passenger'
 WHEN t = 30 THEN 'fishing' WHEN t IN (31,32,33,34,50,51,52,53,54,55,58,59) THEN 'service' WHEN t = 35 THEN 'military' WHEN t IN (36,37) THEN 'leisure' WHEN t BETWEEN 40 AND 49 THEN 'high_speed' ELSE 'other' END AS ship_class, COUNT(*) AS n FROM e GROUP BY 1, 2""")
def code_lookup(spark, folder):
    e = B.table(spark, folder, "events").withColumn("type", F.pmod("event_id", F.lit(100)))
    return e.groupBy("type", ship_class(F.col("type")).alias("ship_class")).agg(F.count("*").alias("n"))


@query("code_texts")
def code_texts(spark, folder):
    e = B.table(spark, folder, "events").select(F.pmod("event_id", F.lit(100)).alias("type"), (F.col("user_id") + F.lit(211_000_000) + F.pmod("event_id", F.lit(300)) * 1_000_000).alias("mmsi"),
                                                F.pmod("event_id", F.lit(16)).alias("nav"))
    return e.groupBy(ship_type_text(F.col("type")).alias("type_text"), nav_status_text(F.col("nav")).alias("nav_text"), flag_state(F.col("mmsi")).alias("flag")).agg(F.count("*").alias("n"))


@query("area_filter", """WITH c AS (SELECT c_custkey, (c_custkey * 7919 % 36000) / 100.0 - 180.0 AS lon, (c_custkey * 104729 % 16000) / 100.0 - 80.0 AS lat FROM customer)
 SELECT c_custkey FROM c WHERE (lat BETWEEN 22 AND 30.5 AND lon BETWEEN 47.5 AND 60.5) OR (lat BETWEEN 49 AND 58.5 AND lon BETWEEN -6 AND 10.5)""")
def area_filter(spark, folder):
    return vessels.in_area(B.customer_points(spark, folder), ["gulf", "north_sea"]).select("c_custkey")
