"""Change and health reports over versions, headlines, findings and runs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import event_time
from ..functions.numbers import stale_after_days


def new_measurements(versions: DataFrame, series: DataFrame, since: Column) -> DataFrame:
    """First vintages seen after an instant, per series."""
    fresh = versions.where((F.col("first_seen_at") > since) & (F.col("revision_no") == 1))
    g = fresh.groupBy("series_id").agg(F.count("*").alias("n_new"), F.max("obs_end").alias("latest"))
    return g.join(series.select("series_id", "name"), "series_id")


def revisions_since(versions: DataFrame, series: DataFrame, since: Column, limit: int = 200) -> DataFrame:
    """The newest revisions of values published before. The limit is the report's length."""
    r = versions.where((F.col("first_seen_at") > since) & (F.col("revision_no") > 1))
    r = r.orderBy(F.col("first_seen_at").desc(), "series_id", "obs_start").limit(limit)
    return r.join(series.select("series_id", "name"), "series_id").select(
        "name", "series_id", "obs_start", "value", "revision_no", "first_seen_at")


def headlines_since(headlines: DataFrame, since: Column, limit: int = 100) -> DataFrame:
    h = headlines.where(F.col("discovered_at") > since).withColumns({
        "t": event_time(F.col("published_at"), F.col("discovered_at")),
        "basis": F.when(F.col("published_at").isNull(), "discovered").otherwise("published")})
    return h.orderBy(F.col("t").desc(), "headline_id").limit(limit).select("title", "publisher", "t", "basis", "url")


def alerts_since(findings: DataFrame, since: Column, limit: int = 30) -> DataFrame:
    a = findings.where(F.col("fired") & (F.col("status") == "active") & F.col("as_of").isNull() & (F.col("created_at") > since))
    return a.orderBy(F.col("severity_rank").desc(), "series_id", "obs_end").limit(limit)


def run_statistics(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "ok").alias("ok_runs"),
                                      F.max("finished_at").alias("last_run"))


def freshness_report(latest: DataFrame, runs: DataFrame, today: Column) -> DataFrame:
    """Age of the newest observation per source beside its run statistics; no observation, no verdict.

    latest: source, frequency, latest_observation.
    """
    d = latest.withColumns({"age_days": F.datediff(today, "latest_observation"),
                            "stale_after_days": stale_after_days(F.col("frequency"))})
    d = d.withColumn("stale", F.col("age_days") > F.col("stale_after_days"))
    return d.join(run_statistics(runs), "source", "left")


def latest_alerts(findings: DataFrame, series: DataFrame, limit: int = 40) -> DataFrame:
    """Latest fired reading per series and rule, newest first."""
    f = findings.where("fired").groupBy("series_id", "rule_id").agg(
        F.max("obs_end").alias("obs_end"), F.max_by("explanation", "obs_end").alias("explanation"))
    f = f.join(series.select("series_id", "name"), "series_id", "left")
    return f.orderBy(F.col("obs_end").desc(), "series_id", "rule_id").limit(limit)


def provenance(findings: DataFrame, versions: DataFrame, raw: DataFrame, id_col: str = "anomaly_id") -> DataFrame:
    """Which stored versions, from which files, a finding rests on."""
    ids = findings.select(id_col, F.explode("input_version_ids").alias("version_id"))
    v = versions.select("version_id", "series_id", "obs_start", "value", "revision_no", "raw_sha256")
    return ids.join(v, "version_id").join(
        raw.select(F.col("sha256").alias("raw_sha256"), "url", "retrieved_at"), "raw_sha256", "left")


def review_state(decisions: DataFrame, at: str, tie: str | None = None) -> DataFrame:
    """One row per card from a log of review entries (card_id, version, decision, note, pinned): each field keeps the latest
    value that was stated for it, so an entry that sets one field leaves the others as they were; the reviewed version is that
    of the latest entry. ``tie`` orders entries of one instant. A partial aggregation; a card with many entries is reduced first."""
    when = F.struct(at, tie) if tie else F.struct(at)

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c)
    return decisions.groupBy("card_id").agg(latest("decision"), latest("note"), latest("pinned"), F.max_by("version", when).alias("reviewed_version"), F.max(at).alias("reviewed_at"))


REVIEW_FILTERS = ("open", "pinned", "dismissed", "all")


def shown_under(name: str) -> Column:
    """Whether a card with its review shows under one of the inbox filters; open means not dismissed."""
    return {"open": F.coalesce(F.col("decision") != "dismissed", F.lit(True)), "pinned": F.coalesce("pinned", F.lit(False)),
            "dismissed": F.coalesce(F.col("decision") == "dismissed", F.lit(False)), "all": F.lit(True)}[name]


def with_review(cards: DataFrame, reviews: DataFrame) -> DataFrame:
    """Cards beside their review decision; flagged when the evidence changed after the review."""
    r = reviews.select("card_id", "decision", "pinned", "reviewed_version")
    return cards.join(r, "card_id", "left").withColumns({
        "pinned": F.coalesce("pinned", F.lit(False)), "decision": F.coalesce("decision", F.lit("open")),
        "updated_since_review": F.coalesce(F.col("reviewed_version") < F.col("version"), F.lit(False))})
