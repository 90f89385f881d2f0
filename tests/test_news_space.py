"""Texts, clusters, cards, digest, geometry, heat events, pixels, vessels, exports."""
import itertools
import json
import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import codes, geo, numbers, text
from tidemark.functions import dates as D
from tidemark.operators import guards, spatial, timeline
from tidemark.operators.matching import linked_series, match_topics, mentioned, topic_series
from tidemark.operators.similarity import cluster_titles, first_matches, similar_variants, variants
from tidemark.plans import cards as C
from tidemark.plans import derived, digest, scenes, thermal, world
from tidemark.sinks import exports as X
from tidemark.streaming import feeds, vessels


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("url,want", [
    ("https://www.Example.com/a/b/?utm_source=x&id=2#frag", "https://example.com/a/b?id=2"),
    ("https://amp.example.com/story/amp/", "https://example.com/story"), ("http://m.x.org", "https://x.org/"),
    ("https://x.org/p?b=2&a=1&empty=&ref=q&refer=1", "https://x.org/p?a=1&b=2&refer=1"), ("https://user@x.org:8080/p/", "https://x.org/p")])
def test_canonical_url(spark, url, want):
    assert one(spark, text.canonical_url(F.lit(url))) == want


def test_text_pieces(spark):
    assert one(spark, text.clean_text(F.lit("<b>Öl &amp; Gas</b>\x07  steigt"), 300)) == "Öl & Gas steigt"
    assert sorted(one(spark, text.title_tokens(F.lit("Die Ölpreise steigen, the price of Öl")))) == ["price", "steigen", "ölpreise"]
    hits = one(spark, text.keyword_hits(F.lit("Dieselpreise, rebrand und SPR-Öl"), ["diesel", "brand", "spr", "öl", "sprit"]))
    assert hits == ["diesel", "spr", "öl"]
    assert one(spark, text.claims(F.lit("Oil prices surge then fall"))) == ["mixed"]
    assert one(spark, text.claimed_direction(text.claims(F.lit("Preise steigen nach Angriff")))) == "disruption"
    assert one(spark, text.dash_slug(F.lit("A b!"))) == "a-b" and one(spark, text.german_slug(F.lit("Köln Süd"))) == "koeln_sued"
    d = spark.createDataFrame([(1, "Tanker near Hormuz"), (2, "Brand in der Stadt"), (3, "Brand in Raffinerie Schwedt")], "id int, t string")
    aliases = [a for v in config.FACILITY_ALIASES.values() for a in v]
    got = {(r.id, r.topic) for r in match_topics(d, "id", F.col("t"), config.TOPICS, aliases, "refinery_disruption").collect()}
    assert (1, "hormuz_shipping") in got and (3, "refinery_disruption") in got and not any(i == 2 for i, _ in got)
    assert [r.entity for r in mentioned(d, "id", F.col("t"), config.FACILITY_ALIASES).collect()] == ["pck_schwedt"]
    m = match_topics(d, "id", F.col("t"), config.TOPICS)
    assert linked_series(m, topic_series(spark, config.TOPICS), "id").where("id = 1").count() == 4


def test_formats(spark):
    f = [numbers.german_percent_text(F.lit(-8.44), 1, True), numbers.german_number_text(F.lit(3.14159), 2), numbers.number_text(F.lit(12345.678), 1, True, True),
         numbers.number_text(F.lit(None).cast("double")), numbers.in_range(F.lit("102.3"), 102.3, 0, 102.2), numbers.german_percent(F.lit("0,8 %"))]
    got = [one(spark, x) for x in f]
    assert got[:5] == ["−8,4 %", "3,14", "+12,345.7%", "n/a", None] and got[5] == pytest.approx(0.008)
    assert one(spark, D.any_date(F.lit("02.03.2026"))) == date(2026, 3, 2) == one(spark, D.any_date(F.lit("2/3/2026")))
    assert one(spark, D.any_date(F.lit("Germany"))) is None
    assert one(spark, D.local_day(F.lit("2026-06-30 22:30:00").cast("timestamp"))) == date(2026, 7, 1)
    assert [one(spark, codes.ship_class(F.lit(x))) for x in (84, 71, 60, 30, 52, 35, 37)] == ["tanker", "cargo", "passenger", "fishing", "service", "military", "leisure"]
    assert one(spark, codes.ship_type_text(F.lit(81))) == "tanker, hazard cat. A" and one(spark, codes.flag_state(F.lit(538001234))) == "Marshall Islands"
    assert one(spark, numbers.display_digits(F.lit("EUR per litre"))) == 3
    assert one(spark, numbers.source_key(F.lit("eia.x"), F.lit("weekly"))) == "eia_weekly"


def plain_clusters(rows, hours=72, threshold=0.6):
    out = {}
    for i, (rid, at, toks) in enumerate(rows):
        for pid, pat, ptoks in rows[:i]:
            if pat >= at - timedelta(hours=hours) and toks and ptoks and len(toks & ptoks) / len(toks | ptoks) >= threshold:
                out[rid] = pid
                break
        else:
            out[rid] = None
    return out


def test_clusters_match_a_plain_walk(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(14)]
    base = [rnd.sample(words, 5) for _ in range(6)]
    rows, t = [], datetime(2026, 1, 1)
    for i in range(160):
        t += timedelta(hours=rnd.choice([0, 0, 1, 9, 30]))
        b = list(rnd.choice(base))
        if rnd.random() < 0.5:
            b[rnd.randrange(5)] = rnd.choice(words)
        rows.append((i, t, set(b) if rnd.random() > 0.05 else set()))
    want = plain_clusters(rows)
    d = spark.createDataFrame([(i, a, " ".join(sorted(s)), sorted(s)) for i, a, s in rows], "id int, at timestamp, title string, tokens array<string>")
    got = {r.id: r.parent for r in first_matches(d, "id", "at").collect()}
    assert got == want
    for hot, block in ((0, 3), (3, 7)):           # every token, or most, in blocks
        assert {r.id: r.parent for r in first_matches(d, "id", "at", hot=hot, block=block).collect()} == want
    labelled, table = cluster_titles(d, "id", "at", "title")

    def root(i):
        while want[i] is not None:
            i = want[i]
        return i
    assert {r.id: r.cluster_id for r in labelled.select("id", "cluster_id").collect()} == {i: root(i) for i in want}
    assert sum(r.n_members for r in table.collect()) == 160


def test_streamed_clusters_equal_batch(spark, tmp_path):
    rnd = random.Random(17)
    words = [f"w{i}" for i in range(12)]
    base = [rnd.sample(words, 4) for _ in range(4)]
    rows, t = [], datetime(2026, 1, 1)
    for i in range(60):
        t += timedelta(hours=rnd.choice([1, 9, 30]))
        b = list(rnd.choice(base))
        if rnd.random() < 0.4:
            b[rnd.randrange(4)] = rnd.choice(words)
        rows.append((i, t, " ".join(b), sorted(set(b))))
    src = tmp_path / "in"
    schema = "id int, at timestamp, title string, tokens array<string>"
    for n in range(3):
        spark.createDataFrame(rows[n * 20:(n + 1) * 20], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = feeds.landing(spark, str(src), spark.read.parquet(str(src)).schema, files_per_batch=1)
    got = {r.id: r.cluster_id for r in feeds.cluster_stream(stream, "id", "at", str(tmp_path / "root")).collect()}
    batch, _ = cluster_titles(spark.createDataFrame(rows, schema), "id", "at", "title")
    assert got == {r.id: r.cluster_id for r in batch.collect()}


def test_neighbours_and_facets(spark):
    d = date(2026, 1, 10)
    ep = spark.createDataFrame([("r", "a", d, d)], "rule_id string, series_id string, episode_start date, obs_end date")
    f = spark.createDataFrame([("b", d, False, "calm"), ("c", d, True, "loud"), ("b", date(2025, 1, 1), False, "old")], "series_id string, obs_end date, fired boolean, explanation string")
    links = spark.createDataFrame([("t", x) for x in "abc"], "topic string, series_id string")
    assert [r.text for r in C.quiet_neighbours(ep, f, links).collect()] == ["b: calm"]
    cards = spark.createDataFrame([("1", ["x"], "headline", "supports", "Brent?"), ("2", ["y"], "anomaly", "context_only", "WTI?")], "card_id string, topics array<string>, kind string, relationship string, question string")
    assert [r.card_id for r in C.facet_filter(cards, ["x", "z"], ["headline"], ["supports"], "brent").collect()] == ["1"] and C.facet_filter(cards).count() == 2


def test_similar_sets_match_all_pairs(spark):
    rnd = random.Random(1)
    sets = [frozenset(rnd.sample(range(30), rnd.randrange(1, 12))) for _ in range(120)]
    sets += [frozenset(list(s)[:-1]) for s in sets[:40] if len(s) > 1]
    sets = sorted({tuple(sorted(map(str, s))) for s in sets})
    v = variants(spark.createDataFrame([(list(s),) for s in sets], "tokens array<string>"))
    key = {r.variant: tuple(r.tokens) for r in v.collect()}
    got = {frozenset((key[r.a], key[r.b])) for r in similar_variants(v).collect()}
    want = {frozenset((a, b)) for a, b in itertools.combinations(sets, 2) if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6}
    assert got == want


def card_world(spark, days=200):
    obs = spark.createDataFrame([("eia.brent_spot", date(2026, 1, 1) + timedelta(days=i), 80 - 0.1 * i, f"v{i}") for i in range(days)],
                                "series_id string, obs_start date, value double, version_id string").withColumn("obs_end", F.col("obs_start"))
    series = spark.createDataFrame([("eia.brent_spot", "Brent spot", "USD per barrel", "EIA", "daily", "World")],
                                   "series_id string, name string, unit string, source string, frequency string, geography string")
    none = spark.createDataFrame([], "series_id string, fired boolean, obs_end date, rule_id string, evaluation string, method string, explanation string, anomaly_id string, baseline_median double")
    return obs, series, none


def headline(spark, title, when):
    return spark.createDataFrame([("h", title, "", None, when, "c", "x")], "headline_id string, title string, excerpt string, published_at timestamp, discovered_at timestamp, cluster_id string, publisher string")


def test_cards_follow_the_evidence(spark):
    obs, series, none = card_world(spark)
    today = F.lit("2026-07-20").cast("date")
    late = C.headline_cards(headline(spark, "Oil prices surge", datetime(2026, 9, 1)), obs, series, none, today).first()
    assert late.relationship == "insufficient_evidence" and late.measurements[0].previous_value is None and late.temporal_note.startswith("Temporal mismatch")
    up = C.headline_cards(headline(spark, "Oil prices surge", datetime(2026, 5, 1)), obs, series, none, today).first()
    assert up.relationship == "complicates" and up.review_flag is None and "moved down" in up.relationship_reason
    down = C.headline_cards(headline(spark, "Oil prices fall", datetime(2026, 5, 1)), obs, series, none, today)
    assert down.first().relationship == "supports" and down.first().evidence_quality == "medium"
    md = X.card_markdown(down.withColumn("version", F.lit(1))).first().value
    assert "| Brent spot [USD per barrel] |" in md and json.loads(X.card_json(down).first().value)["card_id"] == "h-h"
    assert C.recent_headlines(down.withColumn("origin", F.lit("rss")), F.lit("2026-05-03").cast("timestamp")).count() == 1


def test_measure_against_a_plain_look(spark):
    obs, series, none = card_world(spark)
    rnd = random.Random(2)
    obs = obs.where(F.pmod(F.hash("obs_start"), F.lit(3)) != 0)
    rows = [(r.obs_end, r.value) for r in obs.collect()]
    days = [date(2026, 1, 1) + timedelta(days=rnd.randrange(-5, 220)) for _ in range(30)]
    ev = spark.createDataFrame([("eia.brent_spot", d) for d in days], "series_id string, event_day date")
    for m in C.measure(ev, obs, series, none).collect():
        d = m.event_day
        after = [x for x in rows if d <= x[0] <= d + timedelta(days=10)]
        before = [x for x in rows if x[0] < d]
        ctx = [v for x, v in rows if d - timedelta(days=30) <= x < d]
        cur = max(after) if after else max(rows)
        assert m.latest_value == cur[1] and m.post_event == bool(after) and m.ctx_n == len(ctx)
        assert m.previous_value == (max(before)[1] if before and after else None)
        if ctx:
            assert m.ctx_median == pytest.approx(float(np.median(ctx)))


def test_notes_are_checked(spark):
    d = spark.createDataFrame([("Price 81.73 versus 77.71, change +5.17%, 95.00 because of x", [81.73, 77.71, 5.17]), ("Price 81.73 on 2 days", [81.73])], "t string, n array<double>")
    got = [r.issues for r in C.validate_notes(d, "t", "n").collect()]
    assert len(got[0]) == 2 and "95.00" in got[0][0] and got[1] == []


def test_digest_limits(spark):
    rows = [(f"s{i}", "price_daily" if i % 2 else "price_weekly", f"fam{i // 2}", float(20 - i)) for i in range(16)]
    d = spark.createDataFrame(rows, "series_id string, rule_id string, family string, score double")
    got = [(r.series_id, r.family) for r in digest.greedy_pick(d, 4, 6).orderBy("position").collect()]
    seen, per, want = set(), {}, []
    for s, rule, fam, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if fam in seen or per.get(rule, 0) >= 4 or len(want) == 6:
            continue
        seen.add(fam)
        per[rule] = per.get(rule, 0) + 1
        want.append((s, fam))
    assert got == want
    alerts = d.limit(2).select(F.col("series_id").alias("title"), F.lit("x").alias("detail"), F.col("series_id").alias("ref"), "score")
    cards = spark.createDataFrame([("c1", "supports", "T", "P", "why", datetime(2026, 1, 1)), ("c2", "insufficient_evidence", "W", "P", "why", datetime(2026, 1, 1))],
                                  "card_id string, relationship string, title string, publisher string, relationship_reason string, discovered_at timestamp")
    items = digest.build_digest(alerts, cards)
    assert [r.kind for r in items.collect()] == ["unusual", "unusual", "supported", "pending"]
    assert "[WAITING]" in digest.digest_markdown(items, "now").first().value
    line = one(spark, digest.alert_line(F.lit("Brent"), F.lit("price_daily"), F.lit(80.0), F.create_map(F.lit("pct_change"), F.lit(5.0), F.lit("z"), F.lit(4.0)), F.lit("2026-01-01")))
    assert line.title == "Brent: +5.0% in one day"


def plain_km(a, b, c, d):
    p, q = math.radians(b), math.radians(d)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


def test_radius_join_everywhere(spark):
    rnd = random.Random(4)
    pts = [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(150)] + [(150, 179.99, 10.0), (151, 0.0, 89.9), (152, -179.99, -89.95)]
    sites = [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(40)] + [(40, -179.99, 10.0), (41, 120.0, 89.95), (42, 10.0, -89.9)]
    got = {(r.p, r.s) for r in spatial.radius_join(spark.createDataFrame(pts, "p int, lon double, lat double"),
                                                   spark.createDataFrame(sites, "s int, site_lon double, site_lat double"), 900.0, 5.0).collect()}
    assert got == {(i, j) for i, a, b in pts for j, c, d in sites if plain_km(a, b, c, d) <= 900} and (150, 40) in got and (151, 41) in got


def test_thinning_is_greedy(spark):
    rnd = random.Random(5)
    c = [(f"k{i}", "p", "a", 50 + rnd.random() / 100, 26 + rnd.random() / 100, rnd.randrange(1, 5), round(rnd.random() * 40), "unreviewed" if rnd.random() > 0.1 else "masked") for i in range(300)]
    kept = []
    for x in sorted(c, key=lambda x: (x[6], x[0]), reverse=True):
        if x[7] == "unreviewed" and any(k[7] == "unreviewed" and plain_km(x[3], x[4], k[3], k[4]) < 0.1 for k in kept):
            continue
        kept.append(x)
    d = spark.createDataFrame(c, "detection_id string, product_id string, aoi_id string, lon double, lat double, area_px int, peak_db int, review_status string")
    got = scenes.thin_candidates(d)
    assert {r.detection_id for r in got.collect()} == {k[0] for k in kept} and 0 < len(kept) < 300
    water = spark.createDataFrame([("p", "a", 0.9), ("q", "a", 0.5)], "product_id string, aoi_id string, valid_water_fraction double")
    n = {r.product_id: r.candidate_count for r in scenes.snapshot_counts(got, water).collect()}
    assert n == {"p": sum(k[7] == "unreviewed" for k in kept), "q": None}


def test_geometry(spark):
    square = F.array(F.array(*[F.struct(F.lit(a).alias("lon"), F.lit(b).alias("lat")) for a, b in ((56.29, 26.49), (56.31, 26.49), (56.31, 26.51), (56.29, 26.51), (56.29, 26.49))]))
    assert one(spark, geo.in_polygon(F.lit(56.3), F.lit(26.5), square)) and not one(spark, geo.in_polygon(F.lit(56.4), F.lit(26.5), square))
    assert one(spark, geo.distance_to_polygon_km(F.lit(56.4), F.lit(26.5), square)) == pytest.approx(min(plain_km(56.4, 26.5, 56.31, 26.49), plain_km(56.4, 26.5, 56.31, 26.51)))
    assert len(one(spark, geo.wkt_ring(geo.polygon_wkt(square)))) == 5
    box = one(spark, geo.buffered_box(geo.bounding_box(F.flatten(square)), 5.0))
    assert box.south == pytest.approx(26.49 - 5 / 111.32) and box.west < 56.25
    d = spark.range(1).select(geo.wkt_ring(F.lit("POLYGON((55 25, 57 25, 57 27, 55 27, 55 25))")).alias("s"), geo.wkt_ring(F.lit("POLYGON((56 26, 58 26, 58 28, 56 28, 56 26))")).alias("a"), F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("n"))
    r = d.select(spatial.overlap_fraction("s", "a").alias("x"), spatial.overlap_fraction("n", "a").alias("y")).first()
    assert r.x == pytest.approx(0.25) and r.y is None


def test_thermal_labels(spark):
    rows = [(f"n{i:03d}", "VIIRS", "N", datetime(2026, 1, 1, 1) + timedelta(days=i), 56.3, 26.5, "N", 5.0) for i in range(120)]
    rows += [(f"z{i:02d}", "VIIRS", "N", datetime(2026, 5, 2, 1, 0, 15 * i % 60, 0) + timedelta(minutes=i // 4), 56.305, 26.506, "N", 90.0) for i in range(12)]
    det = spark.createDataFrame(rows, "det_id string, source string, satellite string, acq_datetime timestamp, lon double, lat double, daynight string, frp double")
    ring = [[{"lon": a, "lat": b} for a, b in ((56.29, 26.49), (56.31, 26.49), (56.31, 26.51), (56.29, 26.51), (56.29, 26.49))]]
    site = spark.createDataFrame([("ras", ring, [])], "site_id string, rings array<array<struct<lon:double,lat:double>>>, flares array<struct<lon:double,lat:double>>")
    ev = thermal.build_thermal_events(det, site).orderBy("start_at").collect()
    assert ev[0].classification == "routine_flaring_pattern" and ev[-1].classification == "thermal_anomaly_near_facility" and ev[-1].n_detections == 12


def test_sessions_across_buckets(spark):
    rnd = random.Random(6)
    t, rows = datetime(2026, 1, 1), []
    for i in range(400):
        t += timedelta(seconds=rnd.choice([10, 600, 3599, 3600, 3601, 20000]))
        rows.append(("a" if i % 3 else "b", t, i))
    want, last, no = {}, {}, {}
    for k, at, i in rows:
        no[k] = no.get(k, 0) + (k not in last or (at - last[k]).total_seconds() > 3600)
        last[k] = at
        want[i] = no[k]
    d = spark.createDataFrame(rows, "k string, ts timestamp, i int")
    got = {r.i: r.session_no for r in timeline.sessionize(d, ["k"], "ts", 3600, ["i"], bucket_seconds=900).collect()}
    assert got == want


def pixels(spark, bright=1.0, cloud=False, tile="T1"):
    rows = []
    for scene, role in (("pre", "pre"), ("post", "post")):
        for r in range(40):
            for c in range(40):
                burn = role == "post" and 15 <= r < 18 and 15 <= c < 18
                k = bright if role == "post" else 1.0
                rows.append(("s", scene, role, tile if role == "post" else "T1", r, c, (0.1 if burn else 0.4) * k, 0.3 * k, (0.3 if burn else 0.1) * k,
                             9 if cloud and role == "post" and 12 <= r < 24 else 4, 12 <= r < 24 and 12 <= c < 24))
    return spark.createDataFrame(rows, "site_id string, scene string, role string, tile string, row int, col int, b8a double, b11 double, b12 double, scl int, inside boolean")


def test_pixel_change_reasons(spark):
    ok = scenes.pixel_change(pixels(spark)).first()
    assert ok.valid and ok.candidate_pixels == 9 and ok.candidate_area_m2 == 3600 and ok.evaluated_pixels == 144
    assert "unobservable" in scenes.pixel_change(pixels(spark, cloud=True)).first().reasons[0]
    assert "reflectance ratio" in scenes.pixel_change(pixels(spark, bright=1.6)).first().reasons[0]
    assert "one grid" in scenes.pixel_change(pixels(spark, tile="T2")).first().reasons[0]


def test_coverage(spark):
    days, fr = [0, 6, 12, 24, 30], [1.0, 0.95, 0.95, 0.3, 1.0]
    t = [datetime(2026, 1, 1) + timedelta(days=d) for d in days]
    s = spark.createDataFrame([(str(i), "Sentinel-1", "IW_GRDH", a, a, a + timedelta(hours=5), 130, "DESCENDING", "IW", "VV", None, None) for i, a in enumerate(t)],
                              "product_id string, mission string, product_type string, acquisition_start timestamp, acquisition_end timestamp, published_at timestamp, relative_orbit int, "
                              "orbit_direction string, instrument_mode string, polarisation string, cloud_cover double, tile_id string")
    a = spark.createDataFrame([(str(i), "x", f) for i, f in enumerate(fr)], "product_id string, aoi_id string, intersection_fraction double")
    c = scenes.coverage_summary(s, a).first()
    assert (c.n_scenes, c.n_usable, c.max_gap_days, c.median_gap_days, c.median_latency_h) == (5, 4, 18, 6.0, 5.0)
    n = spark.createDataFrame([(str(i), "x", a_, 10 + i) for i, a_ in enumerate(t)], "product_id string, aoi_id string, acquisition_start timestamp, candidate_count int")
    d = [r.difference for r in scenes.snapshot_differences(n, s, a).orderBy("b.acquisition_start").collect()]
    assert d == [1, 1, None, None]


def message(mmsi, lat, lon, **kw):
    body = {"Latitude": lat, "Longitude": lon, "Sog": 12.3, "Cog": 95.0, "TrueHeading": 94, "NavigationalStatus": 0, **kw}
    return json.dumps({"MessageType": "PositionReport", "MetaData": {"MMSI": mmsi, "ShipName": "TEST TANKER"}, "Message": {"PositionReport": body}})


def static(mmsi):
    return json.dumps({"MessageType": "ShipStaticData", "MetaData": {"MMSI": mmsi}, "Message": {"ShipStaticData": {
        "Name": "", "Type": 80, "ImoNumber": 9876543, "CallSign": "ABCD1", "Destination": "<script>alert(1)</script>", "MaximumStaticDraught": 14.2,
        "Dimension": {"A": 200, "B": 50, "C": 20, "D": 24}, "Eta": {"Month": 10, "Day": 7, "Hour": 6, "Minute": 30}}}})


def test_vessels(spark):
    t = datetime(2026, 1, 1)
    rows = [(message(538001234, 26.5, 56.3), t, 1), (static(538001234), t + timedelta(seconds=1), 2), (message(538001234, 91, 181), t + timedelta(seconds=2), 3),
            (message(636009999, 12.6, 43.4, Sog=102.3, Cog=360, TrueHeading=511), t, 4), (message(12, 1, 1), t, 5), (message(538001234, 26.5, 56.3), t + timedelta(seconds=3), 6)]
    m = vessels.parse_messages(spark.createDataFrame(rows, "value string, ts timestamp, k int")).withColumn("k", F.unix_micros("ts"))
    assert m.count() == 4
    s = {r.mmsi: r for r in vessels.snapshot(vessels.latest_state(m), F.lit("2026-01-01 00:00:30").cast("timestamp"), 60).collect()}
    a, b = s[538001234], s[636009999]
    assert (a.ship_class, a.flag, a.imo, a.length, a.beam, a.name, a.eta) == ("tanker", "Marshall Islands", 9876543, 250.0, 44.0, "TEST TANKER", "10-07 06:30 UTC")
    assert "<" not in a.destination and (b.sog, b.cog, b.heading, b.ship_class, b.flag) == (None, None, None, "unknown", "Liberia")
    assert vessels.snapshot(vessels.latest_state(m), F.lit("2026-01-01 00:02:00").cast("timestamp"), 60).count() == 0
    assert {r.mmsi: len(r.track) for r in vessels.tracks(m, "k").collect()} == {538001234: 1, 636009999: 1}
    assert vessels.in_area(vessels.latest_state(m), ["gulf"]).count() == 1
    with pytest.raises(KeyError):
        vessels.in_area(m, ["nowhere"])
    assert {r.ship_class: r.n_vessels for r in vessels.class_counts(vessels.snapshot(vessels.latest_state(m), F.lit("2026-01-01 00:00:30").cast("timestamp"))).collect()} == {"tanker": 1, "unknown": 1}


def test_streams_equal_batch(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rnd = random.Random(9)
    rows = [(i, 538000000 + rnd.randrange(3), t + timedelta(minutes=3 * i), round(rnd.uniform(-5, 5), 1)) for i in range(90)]
    src = tmp_path / "in"
    for n in range(3):
        part = [(message(m, la, 10.0), at, i) for i, m, at, la in rows[n * 30:(n + 1) * 30]]
        spark.createDataFrame(part, "value string, ts timestamp, i int").coalesce(1).write.mode("append").parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = vessels.parse_messages(feeds.landing(spark, str(src), schema, files_per_batch=1)).withColumn("k", F.unix_micros("ts"))
    out = feeds.run_available(vessels.track_stream(stream, stale_after_s=864000, track_len=5), "update", "t").where("NOT expired")
    last = {r.mmsi: (r.lat, r.n, list(r.track_lat)) for r in out.groupBy("mmsi").agg(F.max_by(F.struct("lat", "n", "track_lat"), "batch_id").alias("r")).select("mmsi", "r.*").collect()}
    batch = vessels.parse_messages(spark.read.parquet(str(src))).withColumn("k", F.unix_micros("ts"))
    state = {r.mmsi: r for r in vessels.latest_state(batch).collect()}
    tr = {r.mmsi: [p.lat for p in r.track] for r in vessels.tracks(batch, "k", 5).collect()}
    assert last == {m: (s.lat, s.n_messages, tr[m]) for m, s in state.items()}
    quick = vessels.parse_messages(feeds.landing(spark, str(src), schema, files_per_batch=1)).withColumn("k", F.unix_micros("ts"))
    fast = feeds.run_available(vessels.track_stream(quick, stale_after_s=60, delay="0 seconds"), "update", "t2")
    assert fast.where("expired").count() > 0


def test_stream_merge_calls_dependants_only_on_change(spark, tmp_path):
    src, called = tmp_path / "in", []
    for n, v in enumerate((1.0, 1.0, 2.0)):
        spark.createDataFrame([("s", date(2026, 1, 1), v, datetime(2026, 1, 1) + timedelta(days=n))], "series_id string, obs_start date, value double, seen timestamp").coalesce(1).write.mode("append").parquet(str(src))
    stream = feeds.landing(spark, str(src), spark.read.parquet(str(src)).schema, files_per_batch=1)
    t = feeds.merge_stream(stream, "seen", str(tmp_path / "root"), on_change=lambda df, n: called.append(n))
    assert sorted((r.revision_no, r.value) for r in t.collect()) == [(1, 1.0), (2, 2.0)] and called == [0, 2]


GOLDEN_RATES = [2.2, 1.9, 1.5, 1.0, 0.5, 0.5, 1.5, 1.8, 1.4, 0.5, 3.1, 6.9, 5.9, 2.2, 2.2, 2.5]
# Published nominal prices: total, taxes, grid, procurement; then index and real values.
GOLDEN = {
    1998: ((17.1, 4.0, None, None), 0.8397, (28.89, 6.76, None, None)), 2010: ((23.7, 9.7, 5.8, 8.2), 1.0, (33.63, 13.76, 8.23, 11.63)),
    2011: ((25.2, 11.3, 5.9, 8.0), 1.022, (34.98, 15.69, 8.19, 11.11)), 2012: ((25.9, 11.6, 6.1, 8.2), 1.0414, (35.29, 15.8, 8.31, 11.17)),
    2013: ((28.8, 14.3, 6.6, 7.9), 1.057, (38.66, 19.19, 8.86, 10.6)), 2014: ((29.1, 15.1, 6.6, 7.4), 1.0676, (38.67, 20.07, 8.77, 9.83)),
    2015: ((29.6, 15.0, 6.3, 8.3), 1.0729, (39.14, 19.84, 8.33, 10.98)), 2016: ((29.8, 15.7, 6.6, 7.5), 1.0783, (39.21, 20.66, 8.68, 9.87)),
    2017: ((30.4, 16.2, 7.6, 6.6), 1.0945, (39.41, 21.0, 9.85, 8.56)), 2018: ((30.3, 16.1, 7.3, 7.0), 1.1142, (38.58, 20.5, 9.3, 8.91)),
    2019: ((31.2, 16.1, 7.3, 7.8), 1.1298, (39.18, 20.22, 9.17, 9.8)), 2020: ((32.3, 16.3, 7.7, 8.3), 1.1354, (40.36, 20.37, 9.62, 10.37)),
    2021: ((32.8, 16.5, 7.7, 8.6), 1.1706, (39.75, 20.0, 9.33, 10.42)), 2022: ((46.3, 14.2, 8.0, 24.1), 1.2514, (52.49, 16.1, 9.07, 27.32)),
    2023: ((47.0, 12.6, 9.3, 25.1), 1.3252, (50.32, 13.49, 9.96, 26.87)), 2024: ((40.2, 11.7, 11.4, 17.1), 1.3544, (42.11, 12.26, 11.94, 17.91)),
    2025: ((39.3, 12.6, 10.9, 15.7), 1.3842, (40.28, 12.92, 11.17, 16.09)), 2026: ((37.2, 12.6, 9.3, 15.4), 1.4188, (37.2, 12.6, 9.3, 15.4)),
}


def test_golden_real_prices(spark, tmp_path):
    rows = [(y, None if y < 2011 else GOLDEN_RATES[y - 2011] / 100, *v[0]) for y, v in GOLDEN.items()]
    d = spark.createDataFrame(rows, "year int, rate double, total double, taxes double, grid double, supply double")
    r = derived.real_prices(d, "year", "rate", ["total", "taxes", "grid", "supply"], 2026)
    t = X.real_price_table(r, {"total": "Total", "taxes": "Taxes", "grid": "Grid", "supply": "Supply"}, 2026)
    for x in t.collect():
        want = GOLDEN[x.Jahr]
        assert x.Preisindex == want[1] and (x["Total (real 2026)"], x["Taxes (real 2026)"], x["Grid (real 2026)"], x["Supply (real 2026)"]) == want[2]
    X.write_csv(t, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 18
    long = r.unpivot(["year"], ["real_total", "real_taxes", "real_grid", "real_supply"], "part", "value")
    got = {x.part: round(x.change_pct, 1) for x in derived.real_change(long, ["part"], "year", "value", 2010, 2026).collect()}
    assert got == {"real_total": 10.6, "real_taxes": -8.4, "real_grid": 13.0, "real_supply": 32.4}


def test_balanced_and_arithmetic(spark):
    d = spark.createDataFrame([("SA", "2026-01", 1.0), ("SA", "2026-02", 2.0), ("DE", "2026-01", 3.0), ("DE", "2026-02", None)], "country string, month string, value double")
    months = ["2026-01", "2026-02"]
    assert {r.country: r.included for r in derived.balanced_sample(d, "country", "month", "value", months).collect()} == {"SA": True, "DE": False}
    assert derived.restrict_to_balanced(d, "country", "month", "value", months).count() == 2

    def s(v):
        return spark.createDataFrame([(date(2026, 1, 5), v, "v")], "obs_start date, value double, version_id string")
    assert derived.crack_spread(s(3.0), s(100.0)).first().value == 26.0
    t = derived.tax_split(s(2.38), s(1.40), []).first()
    assert t.vat == pytest.approx(2.38 * 0.19 / 1.19) and t.other_taxes == pytest.approx(0.98 - t.vat)
    assert derived.tax_table(derived.tax_split(s(2.38), s(1.40), []).withColumn("k", F.lit("x")), ["k"], "2026-01-01", "2026-12-31").first().vat_extra == 0


def test_exports_and_guards(spark, tmp_path):
    v = spark.createDataFrame([("s", date(2026, 1, d), date(2026, 1, d), float(d), "ok", None, datetime(2026, 1, 9), datetime(2026, 1, 9), f"{d:064d}", 1, True, f"v{d}") for d in range(1, 28)],
                              "series_id string, obs_start date, obs_end date, value double, status string, source_published_at timestamp, first_seen_at timestamp, retrieved_at timestamp, raw_sha256 string, revision_no int, is_current boolean, version_id string")
    series = spark.createDataFrame([("s", "Name", "transits per day")], "series_id string, name string, unit string")
    e = X.series_export(v, series, ["s"], "2026-01-03")
    assert e.columns == X.SERIES_CSV and e.count() == 25
    note = X.method_note(e, "T", ("2025-01-01", "2025-12-31"), synthetic=True).first().value
    assert "2026-01-03 to 2026-01-27" in note and "SYNTHETIC" in note
    mixed = series.unionByName(spark.createDataFrame([("r", "R", "count in one radar snapshot")], series.schema))
    both = v.unionByName(v.withColumn("series_id", F.lit("r")))
    with pytest.raises(guards.SourceChanged):
        X.series_export(both, mixed, ["s", "r"])
    with pytest.raises(guards.SourceChanged):
        X.snapshot_export(v, "snapshot ships per day")
    assert X.snapshot_export(v).first().unit == scenes.SNAPSHOT_UNIT
    X.write_texts(spark.createDataFrame([("h-1", "text")], "card_id string, value string"), str(tmp_path / "cards"), "card_id")
    assert (tmp_path / "cards" / "item=h-1").exists()
    c = spark.createDataFrame([("s", 1, 2, 3)], "series_id string, n_new long, n_revised long, n_unchanged long")
    row = X.ledger_row("run", "src", "ok", F.current_timestamp(), F.current_timestamp(), c, v).first()
    assert (row.n_new, row.n_revised, row.latest_observation) == (1, 2, date(2026, 1, 27))
    ok = guards.assert_each(v, F.col("value") > 0, F.lit("negative"))
    assert ok.count() == 27
    with pytest.raises(Exception):
        guards.assert_each(v, F.col("value") > 5, F.lit("too small")).collect()
    df, o = X.observed(v, "rows")
    df.write.format("noop").mode("overwrite").save()
    assert o.get["n_rows"] == 27


def test_world_payload_keeps_gaps(spark):
    rows = [("hormuz", date(2025, 1, 1) + timedelta(days=i), 40.0) for i in range(400) if i != 100]
    d = spark.createDataFrame(rows, "series_id string, obs_start date, value double")
    p = world.dense_arrays(d, ["series_id"], "obs_start", "value", "2025-01-01", "2026-02-04").first()
    assert p["values"][100] is None and len(p["values"]) == 400
    assert world.baseline_means(d, ["series_id"], "obs_start", "value", "2025-01-01", "2025-12-31").first().baseline_mean == 40.0
    chip = world.band_with_chip(d.unionByName(spark.createDataFrame([("hormuz", date(2026, 2, 5) + timedelta(days=i), 1.0) for i in range(7)], d.schema)), "obs_start", "2025-01-01", "2025-12-31").first()
    assert chip.chip == "Far below normal"
    assert json.loads(world.line_payload(d, "obs_start").first().payload)["x"][0] == "2025-01-01"
