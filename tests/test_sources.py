"""Readers and guards on small landed files."""
import io
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators.guards import SourceChanged, run_status
from tidemark.sources import feeds as S
from tidemark.sources import jsonstat as J
from tidemark.sources import links as L
from tidemark.sources import workbook as W

def now():
    return F.lit("2026-09-10 12:00:00").cast("timestamp")


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_reference_rates(spark, tmp_path):
    head = "KEY,FREQ,TIME_PERIOD,OBS_VALUE,OBS_STATUS,UNIT\n"
    p = put(tmp_path / "a.csv", head + "".join(f"K,D,2026-03-{d:02d},{1 + d / 100},A,USD\n" for d in range(1, 26)) + "K,D,2026-03-26,NaNope,M,USD\n")
    rows = S.reference_rates(spark, p, "ecb.usd_per_eur").orderBy("obs_start").collect()
    assert len(rows) == 26 and rows[0].value == 1.01 and rows[-1].value is None and rows[-1].status == "missing"
    with pytest.raises(SourceChanged):
        S.reference_rates(spark, put(tmp_path / "b.csv", head + "K,D,2026-03-01,1,A,GBP\n"), "x").collect()
    with pytest.raises(SourceChanged):
        S.reference_rates(spark, put(tmp_path / "c.csv", "<html>no</html>"), "x")
    with pytest.raises(SourceChanged):
        S.reference_rates(spark, put(tmp_path / "d.csv", "KEY,VALUE\n1,2\n"), "x")


def test_paged_json(spark, tmp_path):
    def page(rows, total):
        return json.dumps({"response": {"total": total, "data": [
            {"period": p, "series": "RBRTE", "value": v, "units": u} for p, v, u in rows]}})
    rows = [(f"2026-03-{d:02d}", str(70 + d), "$/BBL") for d in range(1, 8)]
    rows[3] = ("2026-03-04", "--", "$/BBL")
    put(tmp_path / "ok" / "p1.json", page(rows[:5], 7))
    put(tmp_path / "ok" / "p2.json", page(rows[5:], 7))
    cfg = spark.createDataFrame([("RBRTE", "eia.brent_spot", "USD per barrel", "price", False)],
                                "facet string, series_id string, unit string, measure string, weekly boolean")
    got = {r.obs_start: r.value for r in S.paged_series(spark, str(tmp_path / "ok"), cfg).collect()}
    assert len(got) == 7 and got[date(2026, 3, 4)] is None and got[date(2026, 3, 7)] == 77.0
    put(tmp_path / "short" / "p1.json", page(rows[:5], 7))
    with pytest.raises(Exception, match="SourceChanged: pagination incomplete"):
        S.paged_series(spark, str(tmp_path / "short"), cfg).select("obs_end").collect()
    put(tmp_path / "unit" / "p1.json", page([("2026-03-01", "1", "EUR")], 1))
    with pytest.raises(Exception, match="SourceChanged: provider units changed"):
        S.paged_series(spark, str(tmp_path / "unit"), cfg).select("obs_end").collect()
    flow = spark.createDataFrame([("RBRTE", "s", "USD per barrel", "flow", True)], cfg.schema)
    first = S.paged_series(spark, str(tmp_path / "ok"), flow).orderBy("obs_end").first()
    assert (first.obs_end - first.obs_start).days == 6
    facets = spark.createDataFrame([("OTHER",)], "id string")
    assert S.unlisted_series(cfg, facets).count() == 1


def test_jsonstat(spark):
    doc = {"id": ["partner", "time"], "size": [2, 3], "updated": "2026-09-01T11:00:00Z", "dimension": {
        "partner": {"category": {"index": {"NO": 0, "SA": 1}}}, "time": {"category": {"index": {"2026-01": 0, "2026-02": 1, "2026-03": 2}}}},
        "value": {"0": 1.0, "1": 2.0, "3": 5.0, "4": 6.0, "5": 7.0}, "status": {"2": ":"}}
    d = J.decode_jsonstat(spark.createDataFrame([(1, json.dumps(doc))], "k int, doc string"), "doc", ["partner", "time"])
    got = {(r.partner, r.time): (r.value, r.status) for r in d.collect()}
    assert len(got) == 6 and got[("NO", "2026-03")] == (None, ":") and got[("SA", "2026-03")] == (7.0, None)
    s = J.monthly_series(d, "partner", "nrg", "DE").where("series_id = 'eurostat.nrg.de.sa'").orderBy("obs_start").collect()
    assert s[0].obs_end == date(2026, 1, 31) and len(s) == 3
    empty = {**doc, "value": {"3": 1.0}}
    d2 = J.decode_jsonstat(spark.createDataFrame([(1, json.dumps(empty))], "k int, doc string"), "doc", ["partner", "time"])
    assert {r.series_id for r in J.monthly_series(d2, "partner", "nrg", "DE").collect()} == {"eurostat.nrg.de.sa"}
    assert J.monthly_series(d2, "partner", "nrg", "DE", ["NO"]).count() == 3
    assert [r.partner for r in J.missing_codes(d2, "partner", ["NO", "XX"]).collect()] == ["XX"]


def test_national_statistics_and_zip(spark, tmp_path):
    head = "REF_AREA,TIME_PERIOD,ENERGY_PRODUCT,FLOW_BREAKDOWN,UNIT_MEASURE,OBS_VALUE,ASSESSMENT_CODE\n"
    body = "SA,2026-01,CRUDEOIL,INDPROD,KBD,9000,1\nSA,2026-02,CRUDEOIL,INDPROD,KBD,-,3\nXX,2026-01,CRUDEOIL,INDPROD,KBD,1,1\nSA,2010-01,CRUDEOIL,INDPROD,KBD,1,1\n"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("world.csv", head + body)
    p = put(tmp_path / "j.zip", buf.getvalue())
    raw = S.zipped_csv(spark, p, S.NATIONAL + ["ASSESSMENT_CODE"])
    got = S.national_statistics(raw, ["SA"], ["CRUDEOIL"], ["INDPROD"], ["KBD"], "2015-01").orderBy("obs_start").collect()
    assert [(r.value, r.status) for r in got] == [(9000.0, "ok"), (None, "missing")] and got[0].obs_end == date(2026, 1, 31)
    assert json.loads(got[1].attrs) == {"assessment_code": "3", "raw_value": "-"}
    csv = spark.read.option("header", True).csv(put(tmp_path / "j.csv", head + body))
    assert S.national_statistics(csv, ["SA"], ["CRUDEOIL"], ["INDPROD"], ["KBD"], "2015-01").count() == 2


def test_features(spark, tmp_path):
    def attr(k, n, **kw):
        return {"attributes": {"date": 1767301200000 + k * 86400000, "portid": "cp6", "n_tanker": n, "ObjectId": k, **kw}}
    feats = [attr(0, 10), attr(1, None, year=2026, month=1, day=3), attr(0, 12)]
    put(tmp_path / "f.json", json.dumps({"features": feats}))
    ids = spark.createDataFrame([("cp6", "hormuz")], "portid string, slug string")
    got = {r.obs_start: r.value for r in S.daily_features(spark, str(tmp_path / "f.json"), ids, ["n_tanker"]).collect()}
    assert got == {date(2026, 1, 2): 12.0, date(2026, 1, 3): None}
    wanted = spark.createDataFrame([("hormuz", ["strait of HORMUZ", "Hormuz"]), ("nowhere", ["x"])], "slug string, names array<string>")
    known = spark.createDataFrame([("cp6", "Strait of Hormuz"), ("cp7", "Hormuz")], "portid string, portname string")
    assert {r.slug: r.portid for r in S.resolve_names(wanted, known, strict=False).collect()} == {"hormuz": "cp6", "nowhere": None}
    assert S.resolve_names(wanted.where("slug = 'hormuz'"), known).first().portname == "Strait of Hormuz"
    for columns in (["slug"], ["portid"], []):
        with pytest.raises(Exception, match="not found by name: nowhere"):
            S.resolve_names(wanted, known).select(*columns).collect()


def test_port_series_carry_their_group(spark):
    ports = spark.createDataFrame([("port1", "fujairah", "Fujairah", "bypass"), ("port2", "ras", "Ras Tanura", "inside_gulf")], "portid string, slug string, name string, group string")
    got = {r.series_id: r for r in S.port_series(ports, {"portcalls_tanker": ("tanker calls", "calls per day"), "export_tanker": ("tanker exports", "tonnes")}).collect()}
    assert len(got) == 4
    r = got["portwatch.port.ras.export_tanker"]
    assert (r.source_key, r.name, r.geography, r.unit, r.group) == ("port2:export_tanker", "Ras Tanura: tanker exports", "Ras Tanura", "tonnes", "inside_gulf")
    assert r.description == "PortWatch daily port data (inside gulf port)"


def test_thermal_csv(spark, tmp_path):
    p = put(tmp_path / "t.csv", "latitude,longitude,acq_date,acq_time,satellite,confidence,frp,daynight,scan,track\n26.5,56.3,2026-03-01,342,N,n,12.5,N,0.4,0.4\n")
    r = S.thermal_detections(spark, p, "VIIRS").first()
    assert str(r.acq_datetime) == "2026-03-01 03:42:00" and len(r.det_id) == 20 and r.frp == 12.5
    with pytest.raises(SourceChanged):
        S.thermal_detections(spark, put(tmp_path / "bad.csv", "Invalid MAP_KEY.\n"), "VIIRS")


def test_news_and_feeds(spark, tmp_path):
    put(tmp_path / "n.json", json.dumps({"articles": [
        {"url": "https://www.Example.com/a?utm_source=x&id=2", "title": "Oil &amp; gas", "seendate": "20260301T101500Z", "domain": "example.com", "language": "English"},
        {"url": "https://example.com/b", "title": "B", "seendate": "not a date", "domain": "example.com", "language": None}]}))
    rows = S.news_api(spark, str(tmp_path / "n.json"), "q", now()).orderBy("canonical_url").collect()
    assert rows[0].canonical_url == "https://example.com/a?id=2" and rows[0].published_at is None and rows[0].title == "Oil & gas"
    assert str(rows[0].discovered_at) == "2026-03-01 10:15:00" and str(rows[1].discovered_at) == "2026-09-10 12:00:00"
    xml = ("<rss><channel><item><title>One</title><link>https://x.org/a?utm_medium=r</link><pubDate>Mon, 02 Mar 2026 08:00:00 GMT</pubDate><description>d</description></item>"
           "<item><title>One</title><link>https://www.x.org/a</link></item><item><title>no link</title></item></channel></rss>")
    put(tmp_path / "r.xml", xml)
    items = S.rss_items(spark, str(tmp_path / "r.xml"), "X", "en", "https://x.org/feed", now())
    assert items.count() == 2
    one = S.one_per_headline(items).collect()
    assert len(one) == 1 and str(one[0].published_at) == "2026-03-02 08:00:00" and one[0].published_at_source == "feed:published"
    assert S.admitted_feeds(items, "discovery_source").count() == 1
    m = S.manual_headlines(spark.createDataFrame([("https://news.example.org/x", "T", None, None)], "url string, title string, published_at timestamp, publisher string"), now()).first()
    assert m.publisher == "news.example.org" and m.published_at_source is None


def test_pumps(spark, tmp_path):
    put(tmp_path / "p.json", json.dumps({"ok": True, "license": "CC BY 4.0", "prices": {"s1": {"status": "open", "diesel": 1.9, "e5": False, "e10": 0}, "s2": {"status": "closed"}}}))
    panel = spark.createDataFrame([("s1", "Berlin", "A")], "station_id string, city string, brand string")
    got = {r.station_id: (r.status, r.diesel, r.e5, r.e10, r.city) for r in S.pump_prices(spark, str(tmp_path / "p.json"), panel, now()).collect()}
    assert got == {"s1": ("open", 1.9, None, None, "Berlin"), "s2": ("closed", None, None, None, None)}
    put(tmp_path / "q.json", json.dumps({"ok": True, "license": "proprietary", "prices": {}}))
    with pytest.raises(SourceChanged):
        S.pump_prices(spark, str(tmp_path / "q.json"), panel, now())


def test_scenes_and_geojson(spark, tmp_path):
    put(tmp_path / "s.json", json.dumps({"value": [{
        "Id": "p1", "Name": "S1A", "ContentDate": {"Start": "2026-03-01T02:00:00.000Z", "End": "2026-03-01T02:00:25.000Z"}, "PublicationDate": "2026-03-01T07:00:00Z",
        "ModificationDate": "2026-03-01T07:00:00Z", "Online": True, "ContentLength": 5, "Footprint": "geography'SRID=4326;POLYGON ((55 26, 57 26, 57 27, 55 27, 55 26))'",
        "Attributes": [{"Name": "relativeOrbitNumber", "Value": 130}, {"Name": "orbitDirection", "Value": "DESCENDING"}, {"Name": "polarisationChannels", "Value": "VV&VH"}]}]}))
    r = S.scene_catalogue(spark, str(tmp_path / "s.json"), "sentinel1").first()
    assert (r.relative_orbit, r.orbit_direction, r.polarisation, r.cloud_cover) == (130, "DESCENDING", "VV&VH", None)
    assert r.footprint_wkt == "POLYGON ((55 26, 57 26, 57 27, 55 27, 55 26))"
    put(tmp_path / "g.json", json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": "a", "verified": True, "aliases": ["A"], "routine_flare_points": [[56.3, 26.5]]},
         "geometry": {"type": "Polygon", "coordinates": [[[56.29, 26.49], [56.31, 26.49], [56.31, 26.51], [56.29, 26.49]]]}},
        {"type": "Feature", "properties": {"id": "b", "verified": True}, "geometry": None},
        {"type": "Feature", "properties": {"id": "c"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}}]}))
    g = S.geojson_sites(spark, str(tmp_path / "g.json"))
    assert g.count() == 3
    v = S.geojson_sites(spark, str(tmp_path / "g.json"), True).collect()
    assert [x.site_id for x in v] == ["a"] and v[0].flares[0].lon == 56.3 and len(v[0].rings[0]) == 4


def test_company_facts_and_trade(spark, tmp_path):
    e = [{"start": "2026-01-01", "end": "2026-03-31", "val": 10, "fp": "Q1", "form": "10-Q", "filed": "2026-04-20", "accn": "a"},
         {"start": "2026-01-01", "end": "2026-03-31", "val": 11, "fp": "Q1", "form": "10-Q", "filed": "2026-05-20", "accn": "b"},
         {"start": "2026-01-01", "end": "2026-06-30", "val": 30, "fp": "Q2", "form": "10-Q", "filed": "2026-07-20", "accn": "c"},
         {"start": "2025-01-01", "end": "2025-03-31", "val": 1, "fp": "Q1", "form": "8-K", "filed": "2025-04-20", "accn": "d"}]
    put(tmp_path / "c.json", json.dumps({"cik": "34088", "facts": {"us-gaap": {"Revenues": {"units": {"USD": e}}}}}))
    rows = S.company_facts(spark, str(tmp_path / "c.json"), {"Revenues": "USD"}).collect()
    assert [(r.series_id, r.obs_end, r.value) for r in rows] == [("sec.0000034088.revenues", date(2026, 3, 31), 11.0)]
    t = S.monthly_trade(spark, put(tmp_path / "t.csv", "TIME_PERIOD,OBS_VALUE\n2026-02,5\n2026-03,:\n"), "comext.x").orderBy("obs_start").collect()
    assert t[0].obs_end == date(2026, 2, 28) and t[1].value is None


def test_yearly_sheet(spark):
    d = spark.createDataFrame([(2011, "25.2", "2,2 %", None), (2012, "25.9", "1,9 %", "x")], ["Jahr", "Strompreis in ct/kWh", "Inflationsrate", "Unnamed: 5"])
    rows = S.yearly_prices(d, "Jahr", {"Strompreis in ct/kWh": "total"}, "Inflationsrate").collect()
    assert [(r.year, r.total, round(r.rate, 4)) for r in rows] == [(2011, 25.2, 0.022), (2012, 25.9, 0.019)]


def test_links(spark):
    html = ('<a href="/document/download/1?filename=Weekly%20Oil%20Bulletin%20history.xlsx">x</a> <a href="/document/download/2?filename=wo_taxes.xlsx">Prices without taxes</a>'
            '<a href="/other">n</a><a href="/annual-csv/primary/2025.csv">2025</a><a href="/annual-csv/primary/primaryyear2026.csv">2026</a><a href="https://j.org/World_primary_csv.zip">z</a>')
    found = L.links(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html", F.lit("https://e.eu/page/x"))
    assert sorted(r.kind for r in L.workbook_links(found).collect()) == ["history", "latest_without_taxes"]
    years = L.yearly_csv_links(found)
    assert {r.year: r.href for r in years.collect()}[2026] == "https://e.eu/annual-csv/primary/primaryyear2026.csv"
    assert L.years_to_read(years, "refresh", 2015).count() == 2 and L.years_to_read(years, "backfill", 2026).count() == 1
    assert L.archive_links(found).first().kind == "primary"


def xlsx(sheets):
    buf = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        rid = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rid}"><sheets>' + "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(
            f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = "".join("<row>" + "".join(
                f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v is not None) + "</row>"
                for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return buf.getvalue()


def test_workbook_wide(spark, tmp_path):
    head = ["Prices in force on", "DE_price_with_tax_diesel", "DE_price_with_tax_euro95", "EUR_price_with_tax_diesel"]
    rows = [["EUR per 1000 litres"], head] + [[f"2026-03-{d:02d}", "1,751", "1800", "1700"] for d in (2, 9)]
    p = put(tmp_path / "w.xlsx", xlsx({"Prices with taxes": rows, "Notes": [["x"]]}))
    got = {(r.country, r["product"], str(r.obs_date)): r.value for r in W.history_prices(W.read_cells(spark, p), ["DE", "EU"], ["diesel", "euro95"]).collect()}
    assert got[("DE", "diesel", "2026-03-02")] == 1.751 and got[("EU", "diesel", "2026-03-09")] == 1.7 and len(got) == 6
    odd = put(tmp_path / "o.xlsx", xlsx({"Prices with taxes": [head] + [["2026-03-02", "17", "18", "17"]]}))
    with pytest.raises(SourceChanged):
        W.history_prices(W.read_cells(spark, odd), ["DE"], ["diesel"])


def test_workbook_blocks_and_weekly(spark, tmp_path):
    block = [["EUR / 1000 l"], [None, "Euro-super 95", "Automotive gas oil"], ["Germany"], ["02/03/2026", "1600", "1500"], ["FR"], ["02/03/2026", "1650", "1550"]]
    p = put(tmp_path / "b.xlsx", xlsx({"Prices wo taxes": block}))
    got = {(r.country, r["product"], r.tax): r.value for r in W.history_prices(W.read_cells(spark, p), ["DE", "FR"], ["diesel", "euro95"]).collect()}
    assert got[("DE", "diesel", "without_tax")] == 1.5 and got[("FR", "euro95", "without_tax")] == 1.65
    week = [["in EUR per 1000 litres, prices in force on 02.03.2026"], [None, "Euro-super 95", "Automotive gas oil"], ["Germany", "1600", "1500"], ["EU average", "1610", "1510"], ["Total", "1", "2"]]
    cells = W.read_cells(spark, put(tmp_path / "l.xlsx", xlsx({"With taxes": week})))
    latest = W.finish_prices(W.in_euro_per_litre(W.weekly_prices(cells), W.sheet_units(cells)), ["DE", "EU"], ["diesel", "euro95"])
    assert {(r.country, r["product"], str(r.obs_date), r.value) for r in latest.collect()} == {
        ("DE", "diesel", "2026-03-02", 1.5), ("DE", "euro95", "2026-03-02", 1.6), ("EU", "diesel", "2026-03-02", 1.51), ("EU", "euro95", "2026-03-02", 1.61)}


def test_small_parts(spark):
    assert run_status("SourceChanged: x", False) == "schema_changed" and run_status(None, False, True) == "not_modified" and run_status(None, True) == "ok"
    d = spark.range(1).select(S.scrub(F.lit("key=abc"), "abc").alias("t"), S.engine_unit(F.lit("KBD")).alias("u"),
                              S.scan_from("refresh", F.lit("2026-03-31").cast("date"), "2015-01-01").alias("a"), S.scan_from("backfill", F.lit("2026-03-31").cast("date"), "2015-01-01").alias("b")).first()
    assert (d.t, d.u, str(d.a), str(d.b)) == ("key=<redacted>", "thousand barrels per day", "2026-03-01", "2015-01-01")


def test_addresses_and_references(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.text import canonical_url, clean_text
    d = spark.createDataFrame([("http://www.A.de/x/?b=2&a-b=1&a=2&q=a%20b+c&utm_x=1&e=&z=%zz&u=öl~*", "It&#8217;s &#x27;ok&#x27; caf&eacute; &amp;lt; AT&T &foo; <b>x</b>")], "u string, t string")
    r = d.select(canonical_url(F.col("u")).alias("u"), clean_text(F.col("t")).alias("t")).first()
    assert r.u == "https://a.de/x?a=2&a-b=1&b=2&q=a+b+c&u=%C3%B6l~%2A&z=%25zz"
    assert r.t == "It’s 'ok' café &lt; AT&T &foo; x"


def test_atom_entries(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.sources.feeds import rss_items
    (tmp_path / "a.xml").write_text("""<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>
      <entry><title>One</title><link rel="self" href="https://a.de/self"/><link rel="alternate" href="https://a.de/1"/><updated>2024-03-01T10:00:00Z</updated><summary>s</summary></entry>
      <entry><title>Two</title><link href="https://a.de/2"/><published>2024-03-02T10:00:00Z</published></entry><entry><title>None</title></entry></feed>""")
    got = {r.title: r for r in rss_items(spark, str(tmp_path / "a.xml"), "p", "en", "f", F.current_timestamp(), "entry").collect()}
    assert {t: r.canonical_url for t, r in got.items()} == {"One": "https://a.de/1", "Two": "https://a.de/2"}
    assert got["One"].published_at_source == "feed:updated" and got["Two"].published_at_source == "feed:published"


def test_jsonstat_lists_and_errors(spark):
    import json

    import pytest

    from tidemark.sources.jsonstat import decode_jsonstat
    listed = {"id": ["a", "b"], "size": [2, 2], "dimension": {"a": {"category": {"index": ["x", "y"]}}, "b": {"category": {"index": {"p": 0, "q": 1}}}}, "value": [1, None, 3, 4], "status": {"1": "c"}}
    named = listed | {"value": {"0": 1, "2": 3, "3": 4}}
    for doc in (listed, named):
        got = {(r.a, r.b): (r.value, r.status) for r in decode_jsonstat(spark.createDataFrame([(json.dumps(doc),)], "t string"), "t", ["a", "b"]).collect()}
        assert got == {("x", "p"): (1.0, None), ("x", "q"): (None, "c"), ("y", "p"): (3.0, None), ("y", "q"): (4.0, None)}
    with pytest.raises(Exception, match="reports an error"):
        decode_jsonstat(spark.createDataFrame([(json.dumps(named | {"error": "no such code"}),)], "t string"), "t", ["a", "b"]).collect()
