"""Versioned merge, finding store, cards, upserts, reviews."""
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import findings as FS
from tidemark.operators import versioned as V
from tidemark.plans import reports
from tidemark.registry.stores import _stored

T0 = datetime(2026, 5, 1)
EMPTY = ("version_id string, series_id string, obs_start date, obs_end date, value double, status string, source_published_at timestamp, first_seen_at timestamp, "
         "retrieved_at timestamp, raw_sha256 string, revision_no int, is_current boolean, superseded_at timestamp, attrs string")


def at(h=0):
    return F.lit(T0 + timedelta(hours=h))


def batch(spark, values, sid="s"):
    return spark.createDataFrame([(sid, date(2026, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)], "series_id string, obs_start date, value double")


def count(c):
    r = c.first()
    return (r.n_new, r.n_revised, r.n_unchanged)


def test_merge_is_idempotent_and_keeps_vintages(spark):
    v = [80 * (1.001 if i % 2 else 0.999) for i in range(120)]
    t1, c1 = V.merge_observations(spark.createDataFrame([], EMPTY), batch(spark, v), at())
    t1 = t1.cache()
    t2, c2 = V.merge_observations(t1, batch(spark, v), at(1))
    assert count(c1) == (120, 0, 0) and count(c2) == (0, 0, 120) and t2.count() == 120
    w = v[:-1] + [v[-1] + 1.5]
    t3, c3 = V.merge_observations(t2, batch(spark, w), at(24))
    assert count(c3) == (0, 1, 119)
    last = t3.where("obs_start = '2026-04-30'").orderBy("revision_no").collect()
    assert [r.revision_no for r in last] == [1, 2] and [r.is_current for r in last] == [False, True] and last[0].superseded_at == T0 + timedelta(hours=24)
    old = V.observations(t3, at(1)).where("obs_start = '2026-04-30'").collect()
    assert len(old) == 1 and old[0].value == v[-1]
    assert V.has_changes(c3) and not V.has_changes(c2) and V.observations(t3, current_only=False).count() == 121


def test_missing_is_not_zero(spark):
    t1, _ = V.merge_observations(spark.createDataFrame([], EMPTY), batch(spark, [None, float("nan"), 1.0]), at())
    assert [(r.value, r.status) for r in t1.orderBy("obs_start").collect()] == [(None, "missing"), (None, "missing"), (1.0, "ok")]
    _, c = V.merge_observations(t1, batch(spark, [0.0, None, 1.0 + 1e-12]), at(1))
    assert count(c) == (0, 1, 2)
    twice = batch(spark, [1.0]).unionByName(batch(spark, [2.0]))
    assert V.duplicate_keys(twice).count() == 1


def test_one_pass_history_equals_merging_step_by_step(spark):
    import random
    rnd = random.Random(3)
    rows = [(f"s{rnd.randrange(5)}", date(2026, 1, 1 + rnd.randrange(4)), rnd.choice([None, 1.0, 2.0, 3.0]), b) for b in range(6) for _ in range(12)]
    rows = list({(r[0], r[1], r[3]): r for r in rows}.values())
    d = spark.createDataFrame(rows, "series_id string, obs_start date, value double, b int").withColumn("seen", F.timestamp_seconds(F.lit(1_780_000_000) + F.col("b") * 3600))
    cols = ["series_id", "obs_start", "revision_no", "value", "status", "first_seen_at", "superseded_at", "is_current", "version_id"]
    one = V.versions_from_batches(d, "seen").select(*cols)
    table = spark.createDataFrame([], EMPTY)
    streamed = spark.createDataFrame([], EMPTY)
    for b in range(6):
        part = d.where(F.col("b") == b)
        table, _ = V.merge_observations(table, part.select("series_id", "obs_start", "value"), F.timestamp_seconds(F.lit(1_780_000_000 + b * 3600)))
        table = spark.createDataFrame(table.collect(), EMPTY)
    for a, b in ((0, 2), (2, 3), (1, 6)):  # overlapping micro-batches: repeats change nothing
        streamed = V.absorb_batches(streamed, d.where((F.col("b") >= a) & (F.col("b") < b)), "seen")
        streamed = spark.createDataFrame(streamed.collect(), EMPTY)
    want = sorted(map(tuple, one.collect()), key=str)
    assert sorted(map(tuple, table.select(*cols).collect()), key=str) == want
    assert sorted(map(tuple, streamed.select(*cols).collect()), key=str) == want


FINDING = ("rule_id string, series_id string, obs_start date, obs_end date, value double, fired boolean, severity_rank double, formula_version string, "
           "input_version_ids array<string>, explanation string")


def finding(spark, rows):
    return spark.createDataFrame([("r", s, d, d, 1.0, fired, 2.0, "r/v1", ids, "why") for s, d, fired, ids in rows], FINDING)


def test_finding_store(spark):
    d1, d2, d9 = date(2026, 1, 1), date(2026, 1, 3), date(2026, 1, 9)
    f1 = finding(spark, [("s", d1, True, ["a"]), ("s", d2, True, ["b"]), ("s", d9, True, ["c"]), ("s", date(2026, 1, 4), False, ["d"])])
    t1 = FS.store_findings(_stored(spark, f1), f1, at())
    got = {r.obs_start: r for r in t1.collect()}
    assert got[d2].continuation_of == got[d1].anomaly_id and got[d2].severity_rank == 0.5 and got[d9].continuation_of is None
    assert FS.store_findings(t1, f1, at(1)).count() == 4
    t2 = FS.store_findings(t1, finding(spark, [("s", d9, True, ["c2"])]), at(2))
    rows = t2.where("obs_start = '2026-01-09'").collect()
    by = {r.status: r for r in rows}
    assert set(by) == {"active", "superseded"} and by["superseded"].superseded_by == by["active"].anomaly_id
    t3 = FS.store_findings(t2, finding(spark, [("s", d9, True, ["c3"])]), at(3), as_of=at(-5))
    assert t3.where("status = 'replay'").count() == 1 and t3.where("status = 'active'").count() == t2.where("status = 'active'").count()
    gone = FS.mark_unscreened(t2, spark.createDataFrame([("other",)], "group_key string"), F.col("series_id"), at(4))
    assert gone.where("status = 'not_screened'").count() == 4


def test_roots_by_doubling(spark):
    links = [(i, i - 1 if i % 37 else None) for i in range(200)]
    got = {r.id: r.root for r in FS.resolve_root(spark.createDataFrame(links, "id int, parent int"), "id", "parent").collect()}
    assert all(got[i] == i - i % 37 for i in range(200))


def test_cards_version_by_content_and_withdraw(spark):
    empty = spark.createDataFrame([], "card_id string, version int, kind string, status string, created_at timestamp, content_hash string, a int")

    def cards(*rows):
        return spark.createDataFrame([(c, "anomaly", a) for c, a in rows], "card_id string, kind string, a int")
    t1 = FS.store_cards(empty, cards(("x", 1), ("y", 1)), ["a"], at(), ["anomaly"])
    t2 = FS.store_cards(t1, cards(("x", 1), ("y", 1)), ["a"], at(1), ["anomaly"])
    assert t2.count() == 2
    t3 = FS.store_cards(t2, cards(("x", 2)), ["a"], at(2), ["anomaly"])
    assert sorted((r.card_id, r.version, r.status) for r in t3.collect()) == [("x", 1, "superseded"), ("x", 2, "current"), ("y", 1, "withdrawn")]


def test_upserts(spark):
    cur = spark.createDataFrame([("h1", "T", "", None, datetime(2026, 1, 2))], "id string, title string, excerpt string, published timestamp, seen timestamp")
    new = spark.createDataFrame([("h1", "", "E", datetime(2026, 1, 1), datetime(2026, 1, 5)), ("h2", "N", "", None, datetime(2026, 1, 6))], cur.schema)
    got = {r.id: r for r in V.upsert_latest(cur, new, ["id"], [], ["title", "excerpt"], ["published"], ["seen"]).collect()}
    assert got["h1"].title == "T" and got["h1"].excerpt == "E" and got["h1"].published == datetime(2026, 1, 1) and got["h1"].seen == datetime(2026, 1, 2)
    assert got["h2"].title == "N"
    newer = V.update_if_newer(cur.select("id", "seen", "title"), new.select("id", "seen", "title"), ["id"], "seen", ["title"])
    assert {r.id: r.title for r in newer.collect()} == {"h1": "", "h2": "N"}
    cards = spark.createDataFrame([("c1", 2), ("c2", 1)], "card_id string, version int")
    rev = spark.createDataFrame([("c1", "keep", True, 1)], "card_id string, decision string, pinned boolean, reviewed_version int")
    r = {x.card_id: x for x in reports.with_review(cards, rev).collect()}
    assert r["c1"].updated_since_review and r["c1"].pinned and r["c2"].decision == "open" and not r["c2"].updated_since_review


def test_manifest_lists_content_once(spark, tmp_path):
    for n, text in (("a", "x"), ("b", "x"), ("c", "y")):
        (tmp_path / n).write_text(text)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    m = V.raw_manifest(files, None, "src")
    assert m.count() == 2 and V.raw_manifest(files, m, "src").count() == 2


def test_version_id_hashes_key_parts(spark):
    import hashlib
    r = spark.range(1).select(FS.short_hash(20, F.lit("s"), F.lit(None).cast("string"), F.lit(1)).alias("h")).first()
    assert r.h == hashlib.sha1(b"s||1").hexdigest()[:20]
    with pytest.raises(Exception):
        V.merge_observations(spark.createDataFrame([], "a int"), batch(spark, [1.0]), at())


def test_late_rows_take_their_place(spark):
    """Rows of several batches in any order give the history that rows in time would have given."""
    from datetime import date, datetime

    from tidemark.operators.versioned import COLUMNS, absorb_batches
    seen = "series_id string, obs_start date, value double, seen timestamp"
    rows = [("s", date(2024, 1, 1), v, datetime(2024, 2, d)) for v, d in ((1.0, 1), (2.0, 5), (2.0, 6), (3.0, 9))] + [("t", date(2024, 1, 1), 7.0, datetime(2024, 2, 3))]
    types = {"obs_start": "date", "obs_end": "date", "value": "double", "source_published_at": "timestamp", "first_seen_at": "timestamp", "retrieved_at": "timestamp",
             "revision_no": "int", "is_current": "boolean", "superseded_at": "timestamp"}
    empty = spark.createDataFrame([], ", ".join(f"{c} {types.get(c, 'string')}" for c in COLUMNS))
    at_once = absorb_batches(empty, spark.createDataFrame(rows, seen), "seen")
    out = empty
    for k in (3, 0, 4, 1, 2, 1):
        out = spark.createDataFrame(absorb_batches(out, spark.createDataFrame([rows[k]], seen), "seen").collect(), empty.schema)
    pick = ["series_id", "value", "revision_no", "first_seen_at", "superseded_at", "is_current"]
    assert sorted(map(str, out.select(*pick).collect())) == sorted(map(str, at_once.select(*pick).collect())) and out.count() == 4


def test_a_batch_with_a_key_twice_is_refused(spark):
    import pytest
    from pyspark.sql import functions as F

    from tidemark.operators.versioned import COLUMNS, merge_observations
    types = {"obs_start": "date", "obs_end": "date", "value": "double", "source_published_at": "timestamp", "first_seen_at": "timestamp", "retrieved_at": "timestamp",
             "revision_no": "int", "is_current": "boolean", "superseded_at": "timestamp"}
    empty = spark.createDataFrame([], ", ".join(f"{c} {types.get(c, 'string')}" for c in COLUMNS))
    batch = spark.sql("SELECT * FROM VALUES ('s', DATE'2024-01-01', 1.0D), ('s', DATE'2024-01-01', 2.0D) AS t(series_id, obs_start, value)")
    with pytest.raises(Exception, match="twice"):
        merge_observations(empty, batch, F.current_timestamp())[0].collect()


def test_a_cycle_of_links_is_an_error(spark):
    import pytest

    from tidemark.operators.findings import resolve_root
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(50)], "id long, parent long")
    assert {r.root for r in resolve_root(chain, "id", "parent").collect()} == {0}
    with pytest.raises(ValueError, match="cycle"):
        resolve_root(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, parent long"), "id", "parent")
