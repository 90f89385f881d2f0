"""Readers for landed provider files. Each declares its schema and refuses what it does not know."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PROVIDER_UNITS, UNIT_NAMES
from ..functions import dates as D
from ..functions.codes import _lookup
from ..functions.numbers import german_percent
from ..functions.text import canonical_url, clean_text, short_hash
from ..operators.guards import SourceChanged, assert_each, require_columns, require_none, unit_fits
from ..plans.thermal import detection_id
from .archives import MAX_BYTES, ZippedCsv, source_reader


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """The first line of every file under a path, shortened, as ``line``."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return lines.where("b = 0").groupBy("f").agg(F.min_by(F.substring("value", 1, 200), "i").alias("line"))


def read_csv_text(spark: SparkSession, path: str, required: Sequence[str], what: str) -> DataFrame:
    """A headered CSV with every column as text; markup instead of CSV or a missing column stops the run."""
    markup = F.ltrim(F.col("line"), F.lit("\ufeff ")).startswith("<")
    n, any_markup = _first_lines(spark, path).agg(F.count(F.lit(1)), F.max(markup)).first()     # one row, however many files
    if any_markup:
        raise SourceChanged(f"{what}: markup instead of CSV")
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    return require_columns(df, required, what) if n else df


def _observation(series_id: Column, start: Column, end: Column, value: Column, **attrs: Column) -> list[Column]:
    extra = F.to_json(F.struct(*[v.alias(k) for k, v in attrs.items()])) if attrs else F.lit("{}")
    return [series_id.alias("series_id"), start.alias("obs_start"), end.alias("obs_end"), value.alias("value"),
            F.when(value.isNull(), "missing").otherwise("ok").alias("status"), extra.alias("attrs")]


# ------------------------------------------------------------------ yearly price sheet
def yearly_prices(sheet: DataFrame, year: str, rename: dict[str, str], rate: str) -> DataFrame:
    """A wide yearly sheet: unnamed columns out, components renamed, percent text parsed."""
    keep = [c for c in sheet.columns if not c.startswith("Unnamed") and c.strip()]
    cols = [F.col(f"`{year}`").cast("int").alias("year")]
    cols += [F.col(f"`{c}`").try_cast("double").alias(rename[c]) for c in keep if c in rename]
    return sheet.select(*cols, german_percent(F.col(f"`{rate}`")).alias("rate"))


# ------------------------------------------------------------------ SDMX CSV
def reference_rates(spark: SparkSession, path: str, series_id: str, unit: str = "USD") -> DataFrame:
    """Daily reference rates; a UNIT other than the expected one is refused."""
    df = read_csv_text(spark, path, ["TIME_PERIOD", "OBS_VALUE"], "reference-rate CSV")
    if "UNIT" in df.columns:
        require_none(df.where(F.col("UNIT").isNotNull() & (F.col("UNIT") != unit)).select("UNIT").distinct(), "unexpected unit")
    day = F.to_date(F.substring("TIME_PERIOD", 1, 10))
    status = F.col("OBS_STATUS") if "OBS_STATUS" in df.columns else F.lit(None).cast("string")
    return df.select(*_observation(F.lit(series_id), day, day, F.col("OBS_VALUE").try_cast("double"), OBS_STATUS=status))


def monthly_trade(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    df = read_csv_text(spark, path, ["TIME_PERIOD", "OBS_VALUE"], "trade CSV")
    m = F.col("TIME_PERIOD")
    return df.select(*_observation(F.lit(series_id), D.month_start(m), D.month_end(m), F.col("OBS_VALUE").try_cast("double")))


# ------------------------------------------------------------------ paged API JSON
PAGE = "response struct<total:string,data:array<struct<period:string,series:string,value:string,units:string>>>, error string"


def paged_series(spark: SparkSession, path: str, series: DataFrame) -> DataFrame:
    """Pages of an API as observations, in one pass over the pages.

    series: facet, series_id, unit, measure, weekly. Rows must add up to the declared total, provider units
    must fit, a period stated twice counts once (first page first), and null tokens are missing values. What breaks a rule
    fails the query that reads the rows, whichever columns it takes; totals are added up per period before they meet.
    """
    pages = spark.read.schema(PAGE).option("multiLine", True).json(path).withColumn("page", F.input_file_name())
    pages = assert_each(pages, F.col("response.data").isNotNull(), F.concat(F.lit("response without data: "), F.coalesce("error", F.lit("no reason given"))))
    total = F.coalesce(F.col("response.total").cast("long"), F.lit(-1))
    pages = assert_each(pages, (F.size("response.data") > 0) | (total == 0), F.lit("pagination incomplete: an empty page declares rows"))
    rows = pages.select("page", total.alias("total"), F.posexplode("response.data").alias("pos", "r")).select("page", "total", "pos", "r.*")
    d = rows.join(series.withColumnRenamed("facet", "_f"), F.col("series") == F.col("_f"), "left")
    d = assert_each(d, unit_fits("unit", "units"), F.concat(F.lit("provider units changed: "), F.concat_ws(", ", "series", "unit", "units")))
    d = d.groupBy("series", "series_id", "period", "measure", "weekly").agg(
        F.min_by("value", F.struct("page", "pos")).alias("v"), F.count(F.lit(1)).alias("_n"), F.max("total").alias("_total"))
    whole = Window.partitionBy("series", "series_id")          # a row per period, as many as the calendar has
    d = d.withColumns({"_read": F.sum("_n").over(whole), "_declared": F.max("_total").over(whole)})
    short = F.raise_error(F.concat(F.lit("SourceChanged: pagination incomplete: "), F.concat_ws(" ", "series", "_read", F.lit("of"), "_declared"))).cast("boolean")
    # One filter for both: a facet that nobody asked for must not leave before its total was checked.
    d = d.where(F.when(F.col("_read") == F.col("_declared"), F.col("series_id").isNotNull()).otherwise(short))
    end = F.to_date(F.substring("period", 1, 10))
    start = F.when(F.col("weekly"), D.weekly_start(end, F.col("measure"))).otherwise(end)
    value = F.when(F.col("v").isin("", "NA", "--"), None).otherwise(F.col("v").try_cast("double"))
    return d.select(*_observation(F.col("series_id"), start, end, value, period=F.col("period")))


def unlisted_series(configured: DataFrame, facets: DataFrame) -> DataFrame:
    """Configured facets the provider no longer lists."""
    return configured.join(facets.select(F.col("id").alias("facet")), "facet", "left_anti")


def engine_unit(provider_unit: Column) -> Column:
    back = {u: k for k, us in PROVIDER_UNITS.items() for u in us}
    return F.coalesce(_lookup(back, provider_unit), _lookup(UNIT_NAMES, provider_unit))


def scrub(text: Column, secret: str) -> Column:
    """Payload text with a credential blanked before it is stored."""
    return F.replace(text, F.lit(secret), F.lit("<redacted>"))


def scan_from(mode: str, today: Column, backfill_start: str, overlap_days: int = 30) -> Column:
    """First day a run reads: the start of history, or today minus the revision overlap."""
    return F.lit(backfill_start).cast("date") if mode == "backfill" else F.date_sub(today, overlap_days)


# ------------------------------------------------------------------ national statistics CSV / ZIP
NATIONAL = ["REF_AREA", "TIME_PERIOD", "ENERGY_PRODUCT", "FLOW_BREAKDOWN", "UNIT_MEASURE", "OBS_VALUE"]


def national_statistics(raw: DataFrame, countries: Sequence[str], products: Sequence[str], flows: Sequence[str],
                        units: Sequence[str], since: str) -> DataFrame:
    """Filtered monthly statistics: anything that is no number is missing, its text is kept."""
    require_columns(raw, NATIONAL, "national statistics CSV")
    d = raw.where(F.col("REF_AREA").isin(list(countries)) & F.col("ENERGY_PRODUCT").isin(list(products))
                  & F.col("FLOW_BREAKDOWN").isin(list(flows)) & F.col("UNIT_MEASURE").isin(list(units)) & (F.col("TIME_PERIOD") >= since))
    code = F.col("ASSESSMENT_CODE") if "ASSESSMENT_CODE" in raw.columns else F.lit(None).cast("string")
    sid = F.lower(F.concat_ws(".", F.lit("jodi"), "REF_AREA", "ENERGY_PRODUCT", "FLOW_BREAKDOWN", "UNIT_MEASURE"))
    m = F.col("TIME_PERIOD")
    return d.select(*_observation(sid, D.month_start(m), D.month_end(m), F.col("OBS_VALUE").try_cast("double"),
                                  assessment_code=code, raw_value=F.col("OBS_VALUE")))


def zipped_csv(spark: SparkSession, path: str, columns: Sequence[str], members: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """CSV members of ZIP files whose name fits the pattern, as text rows; every member is a task of its own."""
    return source_reader(spark, ZippedCsv, members, max_bytes).schema(", ".join(f"`{c}` string" for c in columns)).load(path)


# ------------------------------------------------------------------ feature service JSON
FEATURES = "features array<struct<attributes:map<string,string>>>, error string"


def daily_features(spark: SparkSession, path: str, ids: DataFrame, fields: Sequence[str], prefix: str = "portwatch") -> DataFrame:
    """Daily transit attributes as one series per place and field.

    ids: portid, slug. Explicit year, month and day beat the shifted epoch; the last row of a day wins; a
    field without a value stays missing.
    """
    pages = spark.read.schema(FEATURES).option("multiLine", True).json(path).withColumn("page", F.input_file_name())
    require_none(pages.where("error IS NOT NULL").select("error"), "feature service error")
    a = pages.select("page", F.posexplode("features.attributes").alias("pos", "a"))
    at = {k: F.try_element_at("a", F.lit(k)) for k in ("year", "month", "day", "date", "portid", "ObjectId")}
    day = D.provider_day(at["year"], at["month"], at["day"], at["date"].try_cast("double"))
    rows = a.select("page", "pos", at["portid"].alias("portid"), day.alias("day"), at["ObjectId"].alias("oid"),
                    *[F.try_element_at("a", F.lit(f)).try_cast("double").alias(f) for f in fields])
    names = [c for c in rows.columns if c not in ("portid", "day", "page", "pos")]
    last = rows.groupBy("portid", "day").agg(F.max_by(F.struct(*names), F.struct("page", "pos")).alias("r"))
    wide = last.join(ids, "portid").select("slug", "day", "r.*")
    long = wide.unpivot(["slug", "day", "oid"], list(fields), "field", "value")
    sid = F.concat_ws(".", F.lit(prefix), "slug", "field")
    return long.select(*_observation(sid, F.col("day"), F.col("day"), F.col("value"), ObjectId=F.col("oid")))


def resolve_names(wanted: DataFrame, known: DataFrame, strict: bool = True) -> DataFrame:
    """slug, names[] against portname, portid: the first alias the provider knows wins, whatever its case.
    A slug that none of its names finds fails the query that reads the rows; with ``strict`` off it stays without an id."""
    alias = wanted.select("slug", F.posexplode("names").alias("pos", "n"))
    k = known.where("portname IS NOT NULL").select(F.lower("portname").alias("key"), "portid", "portname")
    hit = alias.join(k, F.lower("n") == F.col("key")).groupBy("slug").agg(F.min_by(F.struct("portid", "portname"), F.struct("pos", "portid")).alias("r"))
    found = wanted.select("slug").join(hit, "slug", "left")
    if strict:
        found = assert_each(found, F.col("r").isNotNull(), F.concat(F.lit("not found by name: "), "slug"))
    return found.select("slug", "r.portid", "r.portname")


def port_series(ports: DataFrame, fields: dict[str, tuple[str, str]], prefix: str = "portwatch.port") -> DataFrame:
    """Catalogue rows of the daily port series: every configured port (portid, slug, name, group) with every configured field
    (field: its name and unit). The group tells ports that bypass a passage from ports inside it."""
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("field", "title", "unit"), (f, *said))]) for f, said in fields.items()]))
    d = ports.select("portid", "slug", F.col("name").alias("port"), "group", each.alias("f"))
    return d.select(
        F.concat_ws(".", F.lit(prefix), "slug", "f.field").alias("series_id"), F.concat("portid", F.lit(":"), "f.field").alias("source_key"),
        F.concat("port", F.lit(": "), "f.title").alias("name"), F.col("port").alias("geography"), "f.unit", "group",
        F.concat(F.lit("PortWatch daily port data ("), F.replace("group", F.lit("_"), F.lit(" ")), F.lit(" port)")).alias("description"))


# ------------------------------------------------------------------ thermal CSV
THERMAL = ["latitude", "longitude", "acq_date", "acq_time", "confidence", "frp", "daynight", "scan", "track"]


def thermal_detections(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Detections with a repeatable id; error texts in place of data stop the run."""
    line = F.lower("line")
    refused = line.contains("invalid map_key") | line.contains("invalid api") | (line.contains("exceed") & line.contains("transaction"))
    said = _first_lines(spark, path).agg(F.min(F.when(refused, line))).first()[0]
    if said is not None:
        raise SourceChanged(f"thermal source refused: {said[:80]}")
    df = read_csv_text(spark, path, THERMAL, "thermal CSV")

    def num(c: str) -> Column:
        return F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")

    sat = F.col("satellite") if "satellite" in df.columns else F.lit(None).cast("string")
    return df.select(
        detection_id(F.lit(source), num("latitude"), num("longitude"), F.col("acq_date"), F.col("acq_time"), sat).alias("det_id"),
        F.lit(source).alias("source"), sat.alias("satellite"), D.clock_instant(F.col("acq_date"), F.col("acq_time")).alias("acq_datetime"),
        num("latitude").alias("lat"), num("longitude").alias("lon"), F.col("confidence"), F.col("daynight"), num("frp").alias("frp"),
        num("scan").alias("scan"), num("track").alias("track"), num("bright_ti4").alias("bright_ti4"), num("bright_ti5").alias("bright_ti5"))


# ------------------------------------------------------------------ headlines
ARTICLES = "articles array<struct<url:string,title:string,seendate:string,domain:string,language:string>>"


def _headline(url: Column, title: Column, publisher: Column, language: Column, published: Column, published_source: Column,
              discovered: Column, discovery: Column, excerpt: Column, origin: str) -> list[Column]:
    canon = canonical_url(url)
    t, e = clean_text(title, 400), clean_text(excerpt, 300)
    return [short_hash(16, canon).alias("headline_id"), canon.alias("canonical_url"), url.alias("url"), t.alias("title"),
            publisher.alias("publisher"), language.alias("language"), published.alias("published_at"),
            published_source.alias("published_at_source"), discovered.alias("discovered_at"), discovery.alias("discovery_source"),
            e.alias("excerpt"), F.substring(F.sha1(F.concat(t, F.lit("|"), e)), 1, 16).alias("content_hash"), F.lit(origin).alias("origin")]


def news_api(spark: SparkSession, path: str, query: str, now: Column) -> DataFrame:
    """Articles of a news search. The seen date is when it was discovered, never when it was published."""
    none = F.lit(None).cast("timestamp")
    a = spark.read.schema(ARTICLES).option("multiLine", True).json(path).select(F.explode("articles").alias("a")).select("a.*")
    return a.select(*_headline(F.col("url"), F.col("title"), F.col("domain"), F.col("language"), none, F.lit(None).cast("string"),
                               F.coalesce(D.compact_instant(F.col("seendate")), now), F.lit(f"gdelt:{query}"), F.lit(""), "gdelt"))


RSS = ("title string, link array<struct<_VALUE:string,_href:string,_rel:string>>, pubDate string, published string, updated string, "
       "description string, summary string, content string")


def rss_items(spark: SparkSession, path: str, publisher: str, language: str, feed: str, now: Column, row_tag: str = "item") -> DataFrame:
    """Feed items or Atom entries (``row_tag`` "entry") with a link; published where stated, else updated, with the source named.

    A link is an element's text, or the address of an Atom link; among several the alternate one, else the first.
    """
    d = spark.read.format("xml").option("rowTag", row_tag).schema(RSS).load(path)
    stated = F.filter("link", lambda x: F.trim(F.coalesce(x["_href"], x["_VALUE"], F.lit(""))) != "")
    main = F.filter(stated, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    best = F.coalesce(F.get(main, 0), F.get(stated, 0))
    d = d.withColumn("link", F.trim(F.coalesce(best["_href"], best["_VALUE"]))).where("link IS NOT NULL")
    dated = F.regexp_replace(F.regexp_replace("pubDate", r"^\s*[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|UT|Z)$", " +0000")
    pub = F.coalesce(F.try_to_timestamp(dated, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate"), F.try_to_timestamp("published"))
    upd = F.try_to_timestamp("updated")
    source = F.when(pub.isNotNull(), "feed:published").when(upd.isNotNull(), "feed:updated")
    excerpt = F.substring(F.coalesce("description", "summary", "content", F.lit("")), 1, 900)
    return d.select(*_headline(F.trim("link"), F.coalesce("title", F.lit("")), F.lit(publisher), F.lit(language), F.coalesce(pub, upd), source, now,
                               F.lit(f"rss:{feed}"), excerpt, "rss"))


def manual_headlines(rows: DataFrame, now: Column) -> DataFrame:
    """User-entered rows (url, title, published_at, publisher); the host stands in for a missing publisher."""
    host = F.coalesce("publisher", F.parse_url(F.col("url"), F.lit("HOST")), F.lit("manual"))
    return rows.select(*_headline(F.col("url"), F.col("title"), host, F.lit(None).cast("string"), F.col("published_at"),
                                  F.when(F.col("published_at").isNotNull(), "user-entered"), now, F.lit("manual"), F.lit(""), "manual"))


def one_per_headline(rows: DataFrame) -> DataFrame:
    """Repeats of one address inside a batch become one row: earliest discovery, first known publication."""
    names = [c for c in rows.columns if c != "headline_id"]
    g = rows.groupBy("headline_id").agg(
        F.min_by(F.struct(*names), F.struct("discovered_at", "url", "title")).alias("r"), F.min("published_at").alias("p"),
        F.min_by("published_at_source", "published_at").alias("ps"))
    cols = [F.col("p").alias(n) if n == "published_at" else F.col("ps").alias(n) if n == "published_at_source" else F.col("r")[n].alias(n) for n in names]
    return g.select("headline_id", *cols)


def admitted_feeds(items: DataFrame, feed: str) -> DataFrame:
    """Feeds that parsed with at least one item."""
    return items.groupBy(feed).agg(F.count("*").alias("n_items")).where("n_items > 0")


# ------------------------------------------------------------------ pump prices
PUMPS = "ok boolean, license string, message string, prices map<string,struct<status:string,diesel:string,e5:string,e10:string>>"


def pump_prices(spark: SparkSession, path: str, panel: DataFrame, fetched_at: Column) -> DataFrame:
    """Station map of a price response; zero and 'false' prices are missing. panel: station_id, city, brand."""
    d = spark.read.schema(PUMPS).option("multiLine", True).json(path)
    require_none(d.where("NOT coalesce(ok, false)").select("message"), "price service error")
    require_none(d.where("license IS NOT NULL AND license <> '' AND NOT contains(upper(license), 'CC BY')").select("license"), "licence changed")
    p = d.select(F.explode("prices").alias("station_id", "p"))

    def price(c: str) -> Column:
        return F.nullif(F.col(f"p.{c}").try_cast("double"), F.lit(0.0)).alias(c)

    rows = p.select("station_id", fetched_at.alias("fetched_at"), F.col("p.status").alias("status"), price("diesel"), price("e5"), price("e10"))
    return rows.join(panel.select("station_id", "city", "brand"), "station_id", "left")


# ------------------------------------------------------------------ scene catalogue
SCENE = ("value array<struct<Id:string,Name:string,ContentDate:struct<Start:string,`End`:string>,PublicationDate:string,"
         "ModificationDate:string,Online:boolean,ContentLength:bigint,Footprint:string,"
         "Attributes:array<struct<Name:string,Value:string>>>>")


def scene_catalogue(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Catalogue items as typed scene rows; the attribute list becomes columns."""
    from ..functions.geo import footprint_text
    v = spark.read.schema(SCENE).option("multiLine", True).json(path).select(F.explode("value").alias("v")).select("v.*")
    v = v.withColumn("_a", F.map_from_entries(F.array_distinct(F.transform(F.coalesce("Attributes", F.array().cast(
        "array<struct<Name:string,Value:string>>")), lambda a: F.struct(a["Name"], a["Value"])))))

    def attr(n: str) -> Column:
        return F.nullif(F.try_element_at("_a", F.lit(n)), F.lit(""))

    return v.select(
        F.col("Id").alias("product_id"), F.col("Name").alias("product_name"),
        F.lit("Sentinel-1" if collection == "sentinel1" else "Sentinel-2").alias("mission"), attr("productType").alias("product_type"),
        F.lit(collection).alias("collection"), D.iso_instant(F.col("ContentDate.Start")).alias("acquisition_start"),
        D.iso_instant(F.col("ContentDate.End")).alias("acquisition_end"), D.iso_instant(F.col("PublicationDate")).alias("published_at"),
        D.iso_instant(F.col("ModificationDate")).alias("modified_at"), footprint_text(F.col("Footprint")).alias("footprint_wkt"),
        attr("orbitDirection").alias("orbit_direction"), attr("relativeOrbitNumber").try_cast("int").alias("relative_orbit"),
        attr("polarisationChannels").alias("polarisation"), F.coalesce(attr("operationalMode"), attr("sensorMode")).alias("instrument_mode"),
        attr("cloudCover").try_cast("double").alias("cloud_cover"), attr("tileId").alias("tile_id"),
        F.coalesce(attr("platformSerialIdentifier"), attr("platformShortName")).alias("platform"), F.col("Online").alias("online"),
        F.col("ContentLength").alias("size_bytes"))


# ------------------------------------------------------------------ company facts
FACT = "array<struct<`start`:string,`end`:string,val:double,accn:string,fp:string,form:string,filed:string>>"
COMPANY = f"cik string, facts struct<`us-gaap`:map<string,struct<units:map<string,{FACT}>>>>"


def company_facts(spark: SparkSession, path: str, concepts: dict[str, str]) -> DataFrame:
    """Quarterly and yearly facts: the latest filing of a period counts, then the shortest period per start."""
    d = spark.read.schema(COMPANY).option("multiLine", True).json(path)
    c = d.select(F.lpad("cik", 10, "0").alias("cik"), F.explode("facts.us-gaap").alias("concept", "f"))
    unit = _lookup(concepts, F.col("concept"))
    e = c.where(F.col("concept").isin(list(concepts))).select("cik", "concept", F.explode(F.try_element_at("f.units", unit)).alias("e")).select("cik", "concept", "e.*")
    e = e.where("form IN ('10-K', '10-Q') AND fp IS NOT NULL AND fp <> '' AND `start` IS NOT NULL")
    k = ["cik", "concept"]
    best = e.groupBy(*k, "start", "end").agg(F.max_by(F.struct("val", "filed", "accn", "form"), F.struct("filed", "accn")).alias("r"))
    one = best.groupBy(*k, "start").agg(F.min_by(F.struct("end", "r"), "end").alias("x"))
    sid = F.lower(F.concat_ws(".", F.lit("sec"), "cik", "concept"))
    return one.select(*_observation(sid, F.to_date("start"), F.to_date("x.end"), F.col("x.r.val"), accn=F.col("x.r.accn"), form=F.col("x.r.form")),
                      F.to_timestamp("x.r.filed").alias("source_published_at"))


# ------------------------------------------------------------------ GeoJSON
GEO = ("features array<struct<properties:struct<id:string,name:string,verified:boolean,aliases:array<string>,"
       "routine_flare_points:array<array<double>>>,geometry:string>>")


def geojson_sites(spark: SparkSession, path: str, verified_only: bool = False) -> DataFrame:
    """Polygons and multipolygons as arrays of rings; verified sites need a boundary as well."""
    d = spark.read.schema(GEO).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind = F.get_json_object("f.geometry", "$.type")

    def ring(r: Column) -> Column:
        return F.transform(r, lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))

    poly = F.from_json(F.get_json_object("f.geometry", "$.coordinates"), "array<array<array<double>>>")
    multi = F.from_json(F.get_json_object("f.geometry", "$.coordinates"), "array<array<array<array<double>>>>")
    point = F.from_json(F.get_json_object("f.geometry", "$.coordinates"), "array<double>")
    polygons = (F.when(kind == "Polygon", F.array(F.transform(poly, ring)))
                .when(kind == "MultiPolygon", F.transform(multi, lambda p: F.transform(p, ring)))
                .when(kind == "Point", F.array(F.array(F.array(F.struct(F.get(point, 0).alias("lon"), F.get(point, 1).alias("lat")))))))
    flares = F.transform(F.coalesce("f.properties.routine_flare_points", F.array().cast("array<array<double>>")),
                         lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))
    out = d.select(F.col("f.properties.id").alias("site_id"), F.col("f.properties.name").alias("name"), F.coalesce("f.properties.verified", F.lit(False)).alias("verified"),
                   F.col("f.properties.aliases").alias("aliases"), kind.alias("kind"), polygons.alias("polygons"), flares.alias("flares"))
    out = out.withColumn("rings", F.flatten("polygons"))
    return out.where("verified AND polygons IS NOT NULL") if verified_only else out
