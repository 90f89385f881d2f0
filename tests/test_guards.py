"""Guards that no plan drops: reading one column, counting, one pass with its counts, statuses, review fields."""
import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import guards
from tidemark.plans import reports
from tidemark.sources import feeds
from tidemark.sources.jsonstat import decode_jsonstat


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("read", [lambda d: d.collect(), lambda d: d.count(), lambda d: d.select("b").collect(), lambda d: d.select(F.lit(1)).collect(), lambda d: d.groupBy("b").count().collect()])
def test_a_check_is_evaluated_whatever_is_read(spark, read):
    d = spark.createDataFrame([(1, "x"), (-1, "y"), (None, "z")], "a int, b string").repartition(2)
    read(guards.assert_each(d, F.col("a") > -5, F.lit("too small")))
    with pytest.raises(Exception, match="SourceChanged: too small"):
        read(guards.assert_each(d, F.col("a") > 0, F.lit("too small")))


def test_an_error_document_fails_on_any_column(spark):
    doc = {"id": ["a", "time"], "size": [1, 2], "dimension": {"a": {"category": {"index": {"x": 0}}}, "time": {"category": {"index": ["2024-01", "2024-02"]}}}, "value": [1, 2]}
    good, bad = json.dumps(doc), json.dumps(doc | {"error": "no such code"})
    twice = decode_jsonstat(spark.createDataFrame([(1, good), (2, good)], "k int, t string"), "t", ["a", "time"])
    assert sorted((r.k, r.time, r.value) for r in twice.collect()) == [(1, "2024-01", 1.0), (1, "2024-02", 2.0), (2, "2024-01", 1.0), (2, "2024-02", 2.0)]
    d = decode_jsonstat(spark.createDataFrame([(1, good), (2, bad)], "k int, t string"), "t", ["a", "time"])
    for read in (lambda: d.select("time", "value").collect(), lambda: d.select("k").collect(), lambda: d.count()):
        with pytest.raises(Exception, match="no such code"):
            read()


CFG = "facet string, series_id string, unit string, measure string, weekly boolean"


def page(total, *periods, units="$/BBL", facet="RBRTE"):
    return json.dumps({"response": {"total": total, "data": [{"period": p, "series": facet, "value": "70", "units": units} for p in periods]}})


@pytest.mark.parametrize("bad, why", [(page(5, "2026-03-01"), "pagination incomplete"), (page(1, "2026-03-01", units="EUR"), "provider units changed"), (json.dumps({"error": "key"}), "without data"),
                                      (page(3), "empty page"), (page(2, "2026-03-01", facet="OTHER"), "pagination incomplete")])
def test_pages_are_read_once_and_refused_on_any_column(spark, tmp_path, bad, why):
    cfg = spark.createDataFrame([("RBRTE", "eia.brent", "USD per barrel", "price", False)], CFG)
    put(tmp_path / "p1.json", page(2, "2026-03-03", "2026-03-04"))
    put(tmp_path / "p3.json", page(0))
    d = feeds.paged_series(spark, str(tmp_path), cfg)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1          # one scan of the pages
    run = guards.guarded_run(d, "pages")
    assert (run.status, run.n_rows, run.latest) == ("ok", 2, date(2026, 3, 4)) and run.table.count() == 2
    put(tmp_path / "p2.json", bad)
    d = feeds.paged_series(spark, str(tmp_path), cfg)
    for read in (lambda: d.collect(), lambda: d.select("obs_end").collect(), lambda: d.count()):
        with pytest.raises(Exception, match=why):
            read()
    run = guards.guarded_run(d, "pages")
    assert run.status == "schema_changed" and why in run.message and run.table is None


def test_a_run_counts_what_breaks_its_checks_in_the_write(spark):
    d = spark.createDataFrame([(i, float(i % 7), date(2026, 1, 1) + timedelta(i)) for i in range(50)], "k int, value double, obs_end date")
    ok = guards.guarded_run(d, "r", {"range": F.col("value") < 7}, {"median": lambda t: guards.magnitude_violations(t, ["k"], "value", 0, 6)}, changed=lambda t: t.count() > 0)
    assert (ok.status, ok.broken, ok.latest) == ("ok", {"range": 0, "median": 0}, date(2026, 2, 19))
    assert guards.guarded_run(d, "r", changed=lambda t: False).status == "not_modified"
    bad = guards.guarded_run(d, "r", {"range": F.col("value") < 6}, {"median": lambda t: guards.magnitude_violations(t, ["k"], "value", 0, 5)})
    assert (bad.status, bad.broken, bad.table) == ("schema_changed", {"range": 7, "median": 7}, None) and "7 break range" in bad.message
    failed = guards.guarded_run(d.withColumn("value", F.raise_error(F.lit("disk"))), "r")
    assert failed.status == "failed" and "disk" in failed.message


def test_statuses(spark):
    cases = [("NotConfigured: key", "unconfigured"), ("ConnectorStopped: x", "stopped"), ("RateLimited: 429", "paused"), ("CircuitOpen: x", "paused"), ("NetworkUnavailable: x", "unavailable"),
             ("PolicyDenied: x", "denied"), ("SourceChanged: x", "schema_changed"), ("KeyError: 'x'", "failed"), ("?", "failed")]
    assert [guards.run_status(e, False) for e, _ in cases] == [s for _, s in cases]
    assert (guards.run_status(None, True), guards.run_status(None, False, True), guards.run_status(None, True, enabled=False)) == ("ok", "not_modified", "disabled")
    d = spark.createDataFrame([(e, False, True) for e, _ in cases] + [(None, True, True), (None, False, True), ("KeyError", True, False)], "e string, changed boolean, on boolean")
    assert [r.s for r in d.select(guards.run_statuses("e", F.col("changed"), F.col("on")).alias("s")).collect()] == [s for _, s in cases] + ["ok", "not_modified", "disabled"]


def test_review_entries_set_one_field_each(spark):
    t = datetime(2026, 1, 1)
    log = [("a", 1, "dismissed", None, None, t), ("a", 2, None, "look again", None, t + timedelta(1)), ("a", 3, None, None, True, t + timedelta(2)), ("a", 3, "keep", None, None, t - timedelta(1)),
           ("b", 1, "keep", None, True, t), ("b", 1, None, None, False, t + timedelta(1))]
    s = reports.review_state(spark.createDataFrame(log, "card_id string, version int, decision string, note string, pinned boolean, at timestamp"), "at")
    got = {r.card_id: (r.decision, r.note, r.pinned, r.reviewed_version) for r in s.collect()}
    assert got == {"a": ("dismissed", "look again", True, 3), "b": ("keep", None, False, 1)}
    cards = spark.createDataFrame([("a", 4), ("b", 1), ("c", 1)], "card_id string, version int")
    r = reports.with_review(cards, s)
    show = {f: sorted(x.card_id for x in r.where(reports.shown_under(f)).collect()) for f in reports.REVIEW_FILTERS}
    assert show == {"open": ["b", "c"], "pinned": ["a"], "dismissed": ["a"], "all": ["a", "b", "c"]}
    assert {x.card_id for x in r.where("updated_since_review").collect()} == {"a"}


def test_a_page_without_workbooks_fails(spark):
    from tidemark.sources.links import page_workbooks
    link = '<p><a href="/document/download/1?filename=Prices%20%(kind)s.xlsx">x</a></p>'
    page = "".join(link.replace("%(kind)s", k) for k in ("history", "with_tax", "without_tax", "plain")) + '<a href="/document/download/2?filename=a.pdf">pdf</a>'
    good = spark.createDataFrame([(1, page)], "page_id int, html string")
    got = page_workbooks(good, "page_id", "html", F.lit("https://example.org/oil/page")).collect()
    assert sorted(r.kind for r in got) == ["history", "latest_with_taxes", "latest_without_taxes", "other"] and all(r.href.startswith("https://example.org/document/") for r in got)
    bad = good.union(spark.createDataFrame([(2, "<a href='/else'>nothing</a>")], good.schema))
    for columns in (["href"], ["page_id"], []):
        with pytest.raises(Exception, match="no workbook link on page 2"):
            page_workbooks(bad, "page_id", "html").select(*columns).collect()
