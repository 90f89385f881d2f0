"""Card builds over all kinds with withdrawals and returns; derived series that follow revisions of their inputs."""
import json
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import findings as FS
from tidemark.operators.partitioned import ROWS
from tidemark.operators.versioned import merge_observations
from tidemark.plans.derived_store import WedgeInputs, affected_dates, refresh_wedge, wedge_rows

STORED = "card_id string, version int, kind string, status string, created_at timestamp, content_hash string, a int"
T0 = datetime(2026, 1, 1)


def test_cards_go_and_come_back(spark):
    def build(table, n, *cards, looked=()):
        made = spark.createDataFrame(list(cards), "card_id string, kind string, a int")
        seen = spark.createDataFrame([(x,) for x in looked], "card_id string")
        table, out = FS.build_cards(table, made, ["a"], F.lit(T0 + timedelta(n)), ["anomaly"], seen)
        return spark.createDataFrame(table.collect(), STORED), {r.card_id: r.outcome for r in out.collect()}, {r.kind: tuple(r)[1:] for r in FS.build_counts(out).collect()}
    t, out, n = build(spark.createDataFrame([], STORED), 0, ("a1", "anomaly", 1), ("a2", "anomaly", 1), ("h1", "headline", 1), ("h2", "headline", 1), ("c1", "context", 1))
    assert set(out.values()) == {"new"} and n == {"anomaly": (2, 2, 0, 0), "headline": (2, 2, 0, 0), "context": (1, 1, 0, 0)}
    t, out, n = build(t, 1, ("a1", "anomaly", 2), ("c1", "context", 1), looked=["h1"])
    assert out == {"a1": "changed", "a2": "withdrawn", "h1": "withdrawn", "c1": "same"} and n["anomaly"] == (1, 1, 1, 0)
    t, out, n = build(t, 2, ("a2", "anomaly", 1), ("h1", "headline", 5), ("h2", "headline", 1), looked=["h1", "h2"])
    assert out == {"a1": "withdrawn", "a2": "returned", "h1": "returned", "h2": "same"} and n["headline"] == (2, 1, 0, 1)
    t, out, _ = build(t, 3, looked=["zzz"])
    assert out == {"a2": "withdrawn"}
    got = sorted((r.card_id, r.version, r.status, r.a, r.created_at.day) for r in t.collect())
    assert got == [("a1", 1, "superseded", 1, 1), ("a1", 2, "withdrawn", 2, 2), ("a2", 1, "withdrawn", 1, 1), ("a2", 2, "withdrawn", 1, 3), ("c1", 1, "current", 1, 1),
                   ("h1", 1, "withdrawn", 1, 1), ("h1", 2, "current", 5, 3), ("h2", 1, "current", 1, 1)]


def rows(spark, *what):
    return spark.createDataFrame([(s, d, v) for s, d, v in what], "series_id string, obs_start date, value double")


def test_a_revision_makes_new_versions_for_exactly_the_weeks_that_used_it(spark):
    series = WedgeInputs("crude", "rate", F.col("series_id").startswith("pump."))
    day = lambda n: date(2026, 1, 1) + timedelta(n)              # noqa: E731
    first = rows(spark, *[("crude", day(n), 70.0 + n) for n in range(60) if n % 7 < 5], *[("rate", day(n), 1.0 + n / 1000) for n in range(0, 60, 4)],
                 *[(f"pump.{c}", day(n), 2.0 + n / 100) for c in "ab" for n in range(4, 70, 7)], ("pump.a", day(300), 3.0))
    keep = lambda df: spark.createDataFrame(df.collect(), ROWS)
    empty, t = spark.createDataFrame([], ROWS), lambda n: F.lit(T0 + timedelta(n))
    obs = keep(merge_observations(empty, first, t(100))[0])
    derived = keep(merge_observations(empty, wedge_rows(obs, series), t(100))[0])
    alone = derived.where(F.col("obs_start") == day(300)).first()
    assert alone.value is None and alone.status == "missing" and len(json.loads(alone.attrs)["inputs"]) == 1

    def uses(table):
        ids = {r.version_id: (r.series_id, r.obs_start) for r in obs.collect()}
        return {(r.series_id, r.obs_start): {ids[i] for i in json.loads(r.attrs)["inputs"]} for r in table.where("is_current").collect()}
    used = uses(derived)
    for n, change in enumerate([[("crude", day(15), 99.0)], [("rate", day(20), 1.5)], [("pump.a", day(32), 9.0)], [("rate", day(22), 1.4)]]):
        before = obs
        obs = keep(merge_observations(obs, rows(spark, *change), t(101 + n))[0])
        refreshed, counts = refresh_wedge(derived, obs, series, t(101 + n), t(101 + n))
        refreshed = keep(refreshed)
        again = {(r.series_id, r.obs_start) for r in refreshed.where(F.col("first_seen_at") == t(101 + n)).collect()}
        new_key = before.where((F.col("series_id") == change[0][0]) & (F.col("obs_start") == change[0][1])).count() == 0
        if not new_key:
            assert again == {k for k, v in used.items() if change[0][:2] in v} and again
        whole = keep(merge_observations(derived, wedge_rows(obs.where("is_current"), series), t(101 + n))[0])       # everything made again gives the same table
        shown = lambda df: sorted((r.series_id, r.obs_start, r.revision_no, r.is_current, r.first_seen_at, None if r.value is None else round(r.value, 9)) for r in df.collect())
        assert shown(refreshed) == shown(whole)
        reached = {r.obs_start for r in affected_dates(obs.where(F.col("first_seen_at") == t(101 + n)), series).collect()}
        assert {d for _, d in again} <= reached
        derived, used = refreshed, uses(refreshed)
