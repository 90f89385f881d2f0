"""Evidence cards: measurements around an event, claim assessment, notes and their checks."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DIRECTION_WORDS, MIN_MOVE_PCT, TOPICS, WINDOWS
from ..functions.dates import event_basis, event_time
from ..functions.numbers import display_digits, number_text, number_text_digits, pct_change, stale_after_days
from ..functions.text import (
    canonical_number, causal_wording, claims, number_forms, number_tokens, short_hash,
    untraceable_numbers,
)
from ..operators.matching import linked_series, match_topics, topic_series
from ..session import cut_lineage


def measure(events: DataFrame, obs: DataFrame, series: DataFrame, findings: DataFrame,
            windows: Mapping = WINDOWS) -> DataFrame:
    """What each series showed around each event day.

    events: series_id, event_day (any number of rows; distinct pairs are measured once).
    A change is measured only across the event: with nothing dated on or after it, the last reading is
    shown and nothing is compared. Observations, findings and event days of a series are laid on one
    daily axis, so all look-backs and look-aheads are range frames of one sort. The axis of a series is
    bounded by the calendar, however many texts refer to it.
    """
    frames = []
    ev = events.select("series_id", "event_day").distinct().join(series.select("series_id", "frequency"), "series_id")
    ob = obs.where(F.col("value").isNotNull()).join(series.select("series_id", "frequency"), "series_id")
    fd = findings.join(series.select("series_id", "frequency"), "series_id")
    o = F.struct("obs_end", "obs_start", "value", "version_id")
    f = F.struct("fired", "obs_end", "rule_id", "evaluation", "method", "explanation", "anomaly_id", "baseline_median")
    no_o = F.lit(None).cast("struct<obs_end:date,obs_start:date,value:double,version_id:string>")
    no_f = F.lit(None).cast("struct<fired:boolean,obs_end:date,rule_id:string,evaluation:string,method:string,"
                            "explanation:string,anomaly_id:string,baseline_median:double>")
    for freq in windows:
        before, after = windows[freq]["before_days"], windows[freq]["after_days"]
        pick = F.col("frequency") == freq
        if freq == "daily":                                     # a frequency without a window of its own is looked at like a daily one
            pick = F.coalesce(pick | ~F.col("frequency").isin(*windows), F.lit(True))
        axis = (ob.where(pick).select("series_id", F.col("obs_end").alias("day"), o.alias("o"), no_f.alias("f"),
                                      F.lit(False).alias("is_event"))
                .unionByName(fd.where(pick).select("series_id", F.col("obs_end").alias("day"), no_o.alias("o"),
                                                   f.alias("f"), F.lit(False).alias("is_event")))
                .unionByName(ev.where(pick).select("series_id", F.col("event_day").alias("day"), no_o.alias("o"),
                                                   no_f.alias("f"), F.lit(True).alias("is_event"))))
        axis = axis.withColumn("_d", F.unix_date("day"))
        w = Window.partitionBy("series_id").orderBy("_d")
        earlier = w.rangeBetween(Window.unboundedPreceding, -1)
        context = w.rangeBetween(-before, -1)
        later = w.rangeBetween(0, after)
        whole = w.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        both = w.rangeBetween(-before, after)
        v = F.col("o.value")
        d = axis.withColumns({
            "_before": F.last("o", ignorenulls=True).over(earlier), "_after": F.last("o", ignorenulls=True).over(later),
            "_last": F.last("o", ignorenulls=True).over(whole), "ctx_n": F.count(v).over(context),
            "ctx_median": F.percentile(v, 0.5).over(context), "ctx_min": F.min(v).over(context),
            "ctx_max": F.max(v).over(context), "finding": F.max("f").over(both)}).where("is_event")
        frames.append(d.join(series.select("series_id", "frequency"), "series_id"))
    d = reduce(DataFrame.unionByName, frames)
    cur = F.coalesce("_after", "_last")
    d = d.withColumns({"post_event": F.col("_after").isNotNull(), "_cur": cur,
                       "_prev": F.when(F.col("_after").isNotNull(), F.col("_before"))})
    d = d.where("_cur IS NOT NULL")
    return d.select(
        "series_id", F.col("day").alias("event_day"), "frequency", "post_event",
        F.col("_cur.value").alias("latest_value"), F.col("_cur.obs_end").alias("latest_date"),
        F.col("_cur.obs_start").alias("latest_start"), F.col("_prev.value").alias("previous_value"),
        F.col("_prev.obs_end").alias("previous_date"),
        (F.col("_cur.value") - F.col("_prev.value")).alias("abs_change"),
        pct_change(F.col("_cur.value"), F.col("_prev.value")).alias("pct_change"),
        "ctx_n", "ctx_median", "ctx_min", "ctx_max", "finding",
        F.array_sort(F.array_distinct(F.array_compact(F.array(
            "_cur.version_id", "_prev.version_id", "finding.anomaly_id")))).alias("inputs"),
        F.when(~F.col("post_event"), F.concat(
            F.lit("latest observation ("), F.col("_cur.obs_end").cast("string"),
            F.lit(") precedes the headline date ("), F.col("day").cast("string"),
            F.lit("); cannot test the reported event yet"))).alias("note"))


def measure_latest(obs: DataFrame, series: DataFrame, findings: DataFrame, windows: Mapping = WINDOWS) -> DataFrame:
    """The same without an event: latest reading, the one before it, and the window that ends at it."""
    ok = obs.where(F.col("value").isNotNull()).join(series.select("series_id", "frequency"), "series_id")
    w = Window.partitionBy("series_id").orderBy("obs_end")
    before = F
    for freq in ("daily", "weekly", "monthly"):
        before = before.when(F.col("frequency") == freq, windows[freq]["before_days"])
    d = ok.withColumns({"_last": F.max("obs_end").over(Window.partitionBy("series_id")),
                        "_prev": F.lag(F.struct("value", "obs_end", "version_id")).over(w),
                        "_days": before.otherwise(windows["daily"]["before_days"])})
    inside = (F.col("obs_end") >= F.date_sub("_last", F.col("_days"))) & (F.col("obs_end") < F.col("_last"))
    is_last = F.col("obs_end") == F.col("_last")
    g = d.groupBy("series_id", "frequency", "_last", "_days").agg(
        F.max(F.when(is_last, F.struct("value", "obs_start", "version_id", "_prev"))).alias("_c"),
        F.count(F.when(inside, F.col("value"))).alias("ctx_n"),
        F.percentile(F.when(inside, F.col("value")), 0.5).alias("ctx_median"),
        F.min(F.when(inside, F.col("value"))).alias("ctx_min"), F.max(F.when(inside, F.col("value"))).alias("ctx_max"))
    fd = findings.select("series_id", F.struct(
        "fired", "obs_end", "rule_id", "evaluation", "method", "explanation", "anomaly_id", "baseline_median").alias("f"))
    best = (g.select("series_id", "_last", "_days").join(fd, "series_id")
            .where(F.col("f.obs_end").between(F.date_sub("_last", F.col("_days")), F.col("_last")))
            .groupBy("series_id").agg(F.max("f").alias("finding")))
    g = g.join(best, "series_id", "left")
    return g.select(
        "series_id", "frequency", F.col("_c.value").alias("latest_value"), F.col("_last").alias("latest_date"),
        F.col("_c.obs_start").alias("latest_start"), F.col("_c._prev.value").alias("previous_value"),
        F.col("_c._prev.obs_end").alias("previous_date"),
        (F.col("_c.value") - F.col("_c._prev.value")).alias("abs_change"),
        pct_change(F.col("_c.value"), F.col("_c._prev.value")).alias("pct_change"),
        "ctx_n", "ctx_median", "ctx_min", "ctx_max", "finding",
        F.array_sort(F.array_distinct(F.array_compact(F.array(
            "_c.version_id", "_c._prev.version_id", "finding.anomaly_id")))).alias("inputs"))


def freshness(frequency: Column, latest: Column, today: Column) -> Column:
    return F.when(F.datediff(today, latest) <= stale_after_days(frequency), "fresh").otherwise("stale")


# ------------------------------------------------------------------ assessment
def _move(m: Column) -> Column:
    threshold = F.lit(1.0)
    for freq, pct in MIN_MOVE_PCT.items():
        threshold = F.when(m["frequency"] == freq, F.lit(pct)).otherwise(threshold)
    pct = m["pct_change"]
    return F.when(pct.isNull(), None).when(F.abs(pct) < threshold, "flat").when(pct > 0, "up").otherwise("down")


def _pct_text(v: Column) -> Column:
    return number_text(v, 1, signed=True, pct=True)


def assess(cards: DataFrame, labels: str = "claims", measurements: str = "measurements",
           shipping_prefix: str = "portwatch.") -> DataFrame:
    """Add relationship, reason and contrary observations to rows with a claim array and a measurement array.

    Each claim is tested only against the series that can measure it; supporting and complicating results
    together read as complicating. The arrays hold one element per configured series of the topics.
    """
    ms = F.col(measurements)
    post = F.filter(ms, lambda m: m["post_event"] & m["latest_value"].isNotNull())
    d = cards.withColumns({
        "_ship": F.filter(post, lambda m: m["series_id"].startswith(shipping_prefix)),
        "_price": F.filter(post, lambda m: ~m["series_id"].startswith(shipping_prefix))})
    ship, price = F.get("_ship", 0), F.get("_price", 0)
    has = {c: F.array_contains(labels, c) for c in ("up", "down", "disruption")}
    fired = ship["finding"]["fired"]
    below = F.coalesce(ship["finding"]["baseline_median"], F.lit(0.0)) > F.coalesce(ship["latest_value"], F.lit(0.0))
    quiet = ship["finding"].isNotNull() & ~fired & (ship["finding"]["evaluation"] == "evaluated")
    disruption = (F.when(~has["disruption"] | (F.size("_ship") == 0), None)
                  .when(F.coalesce(fired & below, F.lit(False)), "supports")
                  .when(F.coalesce(quiet, F.lit(False)), "complicates").otherwise("insufficient_evidence"))
    direction = F.when(has["up"], "up").when(has["down"], "down")
    move = _move(price)
    price_result = (F.when(direction.isNull() | (F.size("_price") == 0), None)
                    .when(move.isNull(), "insufficient_evidence").when(move == direction, "supports")
                    .otherwise("complicates"))
    d = d.withColumns({"_dis": disruption, "_dir": price_result, "_claim": direction, "_move": move})
    d = d.withColumn("_results", F.array_compact(F.array("_dis", "_dir")))
    any_ = {r: F.array_contains("_results", r) for r in ("supports", "complicates", "insufficient_evidence")}
    no_post = (F.size("_ship") + F.size("_price")) == 0
    relationship = (F.when(no_post, "insufficient_evidence").when(F.size("_results") == 0, "context_only")
                    .when(any_["complicates"], "complicates").when(any_["supports"], "supports")
                    .otherwise("insufficient_evidence"))
    name = F.coalesce(price["name"], F.lit(""))
    dis_text = (F.when(F.col("_dis") == "supports", F.concat(ship["name"], F.lit(
        ": the 7-day mean fell below the fixed baseline band (rule fired).")))
        .when(F.col("_dis") == "complicates", "Reported disruption is not (yet) visible in aggregate transit counts.")
        .when(F.col("_dis").isNotNull(), "Post-event shipping data are incomplete or not evaluable."))
    dir_text = (F.when(F.col("_dir") == "insufficient_evidence",
                       "No comparable pre-event observation to measure a change.")
                .when(F.col("_dir") == "supports", F.concat(
                    name, F.lit(" moved "), F.col("_move"), F.lit(" ("), _pct_text(price["pct_change"]), F.lit(")"),
                    F.when(F.coalesce(price["finding"]["fired"], F.lit(False)), "; screening rule fired")
                    .otherwise("; no screening rule fired, so the move is within normal variability")))
                .when(F.col("_dir") == "complicates", F.concat(
                    F.lit("Headline implies '"), F.col("_claim"), F.lit("', but "), name, F.lit(" moved "),
                    F.col("_move"), F.lit(" ("), _pct_text(price["pct_change"]), F.lit(")."))))
    mixed = any_["supports"] & any_["complicates"]
    reason = (F.when(no_post, "No relevant observation is dated on/after the reported event; all available data precede it.")
              .when(F.size("_results") == 0,
                    "The headline makes no directional claim that the available post-event indicators can test.")
              .otherwise(F.concat(F.when(mixed, "Mixed: ").otherwise(""), F.concat_ws(" ", dis_text, dir_text))))
    others = F.slice("_price", F.lit(2), F.greatest(F.size("_price") - 1, F.lit(0)))
    against = F.array_compact(F.transform(others, lambda m: F.when(
        F.col("_claim").isNull(), None).when(_move(m) == "flat", F.concat(
            m["name"], F.lit(" barely changed ("), _pct_text(m["pct_change"]), F.lit(")"))).when(
        _move(m) != F.col("_claim"), F.concat(m["name"], F.lit(" moved "), _move(m), F.lit(" ("),
                                              _pct_text(m["pct_change"]), F.lit(")")))))
    ship_note = F.array_compact(F.array(
        F.when(F.col("_dis") == "complicates", F.concat(ship["name"], F.lit(" stayed within its baseline band: "),
                                                        ship["finding"]["explanation"])),
        F.when(has["disruption"] & (F.size("_ship") == 0) & ~no_post,
               "No post-event shipping observation yet (provider lag) — the disruption claim is untested.")))
    return d.withColumns({"relationship": relationship, "relationship_reason": reason,
                          "contrary_observations": F.concat(ship_note, against)}).drop(
        "_ship", "_price", "_dis", "_dir", "_claim", "_move", "_results")


def quality(cards: DataFrame, measurements: str = "measurements", hits: str = "n_hits", members: str = "n_members",
            geography: str = "geography") -> DataFrame:
    """Evidence quality, freshness and editorial relevance as three separate ratings."""
    ms = F.col(measurements)
    post = F.filter(ms, lambda m: m["post_event"])
    scored = F.filter(post, lambda m: m["finding"].isNotNull() & F.coalesce(
        m["finding"]["method"] != "suppressed", F.lit(False)))
    g = F.lower(geography)
    wide = (F.col(members) >= 2) | g.contains("germany") | g.contains("eu")
    return cards.withColumns({
        "evidence_quality": F.when(F.size(scored) > 0, "high").when(F.size(post) > 0, "medium").otherwise("low"),
        "n_post_event": F.size(post), "n_scored": F.size(scored),
        "freshness": F.when(F.exists(ms, lambda m: m["freshness"] == "fresh"), "fresh").otherwise("stale"),
        "editorial_relevance": F.when((F.col(hits) >= 2) & wide, "high").when(F.col(hits) >= 1, "medium").otherwise("low")})


# ------------------------------------------------------------------ texts
def question(title: Column, claim: Column, labels: Column) -> Column:
    quoted = F.concat(F.lit('"'), title, F.lit('"'))
    return (F.when(claim == "disruption", F.concat(F.lit("Do aggregate measurements ("), labels, F.lit(
        ") after the report show the disruption described in: "), quoted, F.lit("?")))
        .when(claim.isin("up", "down"), F.concat(F.lit("Did the relevant indicators ("), labels, F.lit(") move "), claim,
                                                 F.lit(" around the time of: "), quoted, F.lit("?")))
        .otherwise(F.concat(F.lit("What do the relevant indicators ("), labels, F.lit(") show around the time of: "),
                            quoted, F.lit("?"))))


def follow_up(relationship: Column, topics: Column, frequencies: Column) -> Column:
    waiting = F.when(F.size(frequencies) > 0, F.array_join(frequencies, "/")).otherwise("next")
    return (F.when(relationship == "insufficient_evidence", F.concat(F.lit("Re-run after the next "), waiting, F.lit(
        " releases; check whether post-event observations change the picture.")))
        .when(relationship == "complicates", "Which other sources (company statements, regional prices, satellite "
              "coverage) could explain the gap between the report and the data?")
        .when(F.array_contains(topics, "german_fuel_prices"), "How much of the change is taxes vs pretax price, and how "
              "does it compare with the euro crude cost lagged one week?")
        .otherwise("Is the move persistent over the next releases, and does it appear in independent series?"))


def note_lines(measurements: Column) -> Column:
    """One line per measurement in the wording of a research note."""
    def line(m: Column) -> Column:
        change = F.concat(
            F.lit(", versus "), number_text_digits(m["previous_value"], m["digits"]), F.lit(" on "),
            m["previous_date"].cast("string"), F.lit(" (change "),
            number_text_digits(m["abs_change"], m["digits"], signed=True),
            F.when(m["pct_change"].isNotNull(), F.concat(F.lit(", "), _pct_text(m["pct_change"]))).otherwise(""), F.lit(")"))
        rule = F.concat(F.lit(". Screening rule "), m["finding"]["rule_id"],
                        F.when(m["finding"]["fired"], ": FIRED").otherwise(": did not fire"))
        return F.concat(
            F.lit("- "), m["name"], F.lit(" ("), m["unit"], F.lit("): "),
            number_text_digits(m["latest_value"], m["digits"]), F.lit(" on "), m["latest_date"].cast("string"),
            F.when(m["previous_value"].isNotNull(), change).otherwise(""),
            F.coalesce(rule, F.lit("")), F.coalesce(F.concat(F.lit(". "), m["note"]), F.lit("")), F.lit("."))
    return F.transform(measurements, line)


def template_note(question_: Column, measurements: Column, relationship: Column, reason: Column,
                  temporal: Column) -> Column:
    return F.concat_ws(
        "\n", F.concat(F.lit("Question tested: "), question_), F.array_join(note_lines(measurements), "\n"),
        F.concat(F.lit("Assessment: "), F.translate(relationship, "_", " "), F.lit(". "), F.coalesce(reason, F.lit(""))),
        temporal, F.lit("Timing alone is not evidence of a causal link; see alternative explanations and limitations."))


def validate_notes(notes: DataFrame, text: str, numbers: str | None = None, texts: Sequence[str] = ()) -> DataFrame:
    """Add ``issues``: number tokens no calculation covers, and conclusive wording.

    numbers: array<double> of calculated values; texts: columns whose own numbers may be repeated.
    """
    allowed = F.array().cast("array<string>")
    if numbers:
        allowed = F.concat(allowed, F.flatten(F.transform(numbers, number_forms)))
    for t in texts:
        allowed = F.concat(allowed, F.transform(number_tokens(F.col(t)), canonical_number))
    d = notes.withColumn("_allowed", F.array_distinct(allowed))
    bad = F.transform(untraceable_numbers(F.col(text), F.col("_allowed")),
                      lambda t: F.concat(F.lit("number not traceable to a calculation: "), t))
    words = F.transform(causal_wording(F.col(text)), lambda t: F.concat(F.lit("causal/conclusive language: "), t))
    return d.withColumn("issues", F.concat(bad, words)).drop("_allowed")


# ------------------------------------------------------------------ the three kinds of card
MEASUREMENT = ["link_order", "series_id", "name", "unit", "source", "frequency", "digits", "post_event", "latest_value",
               "latest_date", "latest_start", "previous_value", "previous_date", "abs_change", "pct_change", "ctx_n",
               "ctx_median", "ctx_min", "ctx_max", "finding", "freshness", "note", "inputs"]


def headline_cards(headlines: DataFrame, obs: DataFrame, series: DataFrame, findings: DataFrame, today: Column,
                   topics: Mapping = TOPICS, members: DataFrame | None = None, windows: Mapping = WINDOWS,
                   words: Mapping = DIRECTION_WORDS) -> DataFrame:
    """One card per headline that matches a topic.

    headlines: headline_id, title, excerpt, published_at, discovered_at, cluster_id.
    """
    spark = headlines.sparkSession
    text = F.concat_ws(" ", F.col("title"), F.coalesce("excerpt", F.lit("")))
    # Three branches below need the matches. They are ids and keywords, far smaller than the texts, so they
    # are kept once in the shared folder rather than searching every text three times.
    matches = cut_lineage(match_topics(headlines, "headline_id", text, topics))
    links = topic_series(spark, topics)
    labels = spark.createDataFrame([(t, c["label"], c["geography"], list(c.get("alternatives", [])))
                                    for t, c in topics.items()],
                                   "topic string, label string, geo string, alternatives array<string>")
    per_doc = matches.join(labels, "topic").groupBy("headline_id").agg(
        F.array_sort(F.collect_set("topic")).alias("topics"), F.sum(F.size("hits")).alias("n_hits"),
        F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"),
        F.array_join(F.array_sort(F.collect_set("geo")), ", ").alias("geography"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("alternatives")))).alias("alternatives"))
    head = headlines.join(per_doc, "headline_id").withColumns({
        "event_at": event_time(F.col("published_at"), F.col("discovered_at")),
        "event_time_basis": event_basis(F.col("published_at")), "claims": claims(F.col("title"), words)})
    head = head.withColumn("event_day", F.to_date("event_at"))
    wanted = linked_series(matches, links, "headline_id").join(head.select("headline_id", "event_day"), "headline_id")
    m = measure(wanted, obs, series, findings, windows).join(
        series.select("series_id", "name", "unit", "source"), "series_id")
    m = m.withColumns({"digits": display_digits(F.col("unit")),
                       "freshness": freshness(F.col("frequency"), F.col("latest_date"), today)})
    per_card = wanted.join(m, ["series_id", "event_day"]).groupBy("headline_id").agg(
        F.sort_array(F.collect_list(F.struct(*MEASUREMENT))).alias("measurements"))
    empty = F.array().cast(per_card.schema["measurements"].dataType)
    c = head.join(per_card, "headline_id", "left").withColumn("measurements", F.coalesce("measurements", empty))
    if members is not None:
        c = c.join(members.select("cluster_id", "n_members"), "cluster_id", "left")
    else:
        c = c.withColumn("n_members", F.lit(1))
    c = quality(assess(c.withColumn("n_members", F.coalesce("n_members", F.lit(1)))))
    any_post = F.exists("measurements", lambda x: x["post_event"])
    newest = F.array_max(F.transform("measurements", lambda x: x["latest_date"]))
    temporal = F.when((F.col("relationship") == "insufficient_evidence") & (F.size("measurements") > 0) & ~any_post, F.concat(
        F.lit("Temporal mismatch: the newest relevant observation is dated "), newest.cast("string"),
        F.lit(", before the headline's "), F.col("event_time_basis"), F.lit(" ("), F.col("event_day").cast("string"),
        F.lit("). Observations that precede an event cannot test it. Re-check after the next releases.")))
    fired = F.exists("measurements", lambda x: F.coalesce(x["finding"]["fired"], F.lit(False)))
    freqs = F.array_sort(F.array_distinct(F.transform("measurements", lambda x: x["frequency"])))
    up_or = F.when(F.array_contains("claims", "up"), "up").when(F.array_contains("claims", "down"), "down").when(
        F.array_contains("claims", "disruption"), "disruption")
    c = c.withColumns({
        "card_id": F.concat(F.lit("h-"), F.col("headline_id").cast("string")), "kind": F.lit("headline"),
        "temporal_note": temporal, "question": question(F.col("title"), up_or, F.col("labels")),
        "signal_strength": F.when(fired, "strong").when(F.size("measurements") > 0, "weak").otherwise("none"),
        "follow_up": follow_up(F.col("relationship"), F.col("topics"), freqs),
        "input_version_ids": F.array_sort(F.array_distinct(F.flatten(F.transform("measurements", lambda x: x["inputs"])))),
        "charts": F.slice(F.transform("measurements", lambda x: x["series_id"]), 1, 3)})
    c = c.withColumn("narrative", template_note(F.col("question"), F.col("measurements"), F.col("relationship"),
                                                F.col("relationship_reason"), F.col("temporal_note")))
    return review_flag(c)


def review_flag(cards: DataFrame) -> DataFrame:
    """Flag a card whose note uses a number or a wording its calculations do not carry."""
    numbers = F.flatten(F.transform("measurements", lambda m: F.array_compact(F.array(
        m["latest_value"], m["previous_value"], m["abs_change"], m["pct_change"]))))
    # Joined by a mark no number token contains: two texts never run into one number.
    texts = F.concat_ws("|", F.array_join(F.flatten(F.transform("measurements", lambda m: F.array_compact(F.array(
        m["latest_date"].cast("string"), m["previous_date"].cast("string"), m["name"], m["unit"], m["note"],
        m["finding"]["rule_id"])))), "|"), "question", "relationship_reason", F.coalesce("temporal_note", F.lit("")))
    d = cards.withColumns({"_numbers": numbers, "_texts": texts})
    d = validate_notes(d, "narrative", "_numbers", ["_texts"])
    return d.withColumn("review_flag", F.when(F.size("issues") > 0, F.concat(
        F.lit("template validation issues: "), F.array_join("issues", "; ")))).drop("_numbers", "_texts", "issues")


def context_cards(obs: DataFrame, series: DataFrame, findings: DataFrame, keys: Sequence[str], today: Column) -> DataFrame:
    m = measure_latest(obs.where(F.col("series_id").isin(list(keys))), series, findings).join(
        series.select("series_id", "name", "unit", "geography"), "series_id")
    fired = F.coalesce(F.col("finding.fired"), F.lit(False))
    status = (F.when(fired, "screening rule FIRED — see anomaly card")
              .when(F.col("finding").isNotNull(), "no screening rule fired (normal range)")
              .otherwise("no screening evaluation available"))
    scored = F.coalesce(F.col("finding.method") != "suppressed", F.lit(False))
    return m.withColumns({
        "card_id": F.concat(F.lit("c-"), F.col("series_id")), "kind": F.lit("context"),
        "question": F.concat(F.lit("Where does "), F.col("name"), F.lit(" stand now relative to its recent range?")),
        "relationship": F.lit("context_only"),
        "relationship_reason": F.concat(F.lit("Context reading; "), status, F.lit(".")),
        "signal_strength": F.when(fired, "strong").otherwise("none"),
        "evidence_quality": F.when(scored, "high").otherwise("medium"),
        "freshness": freshness(F.col("frequency"), F.col("latest_date"), today),
        "input_version_ids": F.col("inputs")})


def anomaly_cards(episodes: DataFrame, series: DataFrame, related: DataFrame) -> DataFrame:
    """One card per alert episode with its latest reading. related: series_id, start_at, n_related."""
    info = series.select("series_id", "name", "unit", "geography", "frequency")
    c = episodes.join(info, "series_id", "left").join(related, ["series_id", "episode_start"], "left")
    n = F.coalesce("n_related", F.lit(0))
    windows = F.coalesce(F.try_element_at("stats", F.lit("n_baseline_windows")), F.lit(0.0))
    return c.withColumns({
        "card_id": F.concat(F.lit("a-"), short_hash(20, F.col("rule_id"), F.col("series_id"), F.col("episode_start"))),
        "kind": F.lit("anomaly"), "relationship": F.lit("context_only"), "signal_strength": F.lit("strong"),
        "relationship_reason": F.lit("Screening rule fired; related reporting is listed for context only."),
        "question": F.concat(F.lit("What explains the unusual reading in "), F.coalesce("name", "series_id"), F.lit(" for "),
                             F.col("obs_start").cast("string"), F.lit(".."), F.col("obs_end").cast("string"), F.lit("?")),
        "evidence_quality": F.when((F.col("method") == "MAD") | (windows >= 60), "high").otherwise("medium"),
        "editorial_relevance": F.when(n > 0, "high").otherwise("medium"),
        "follow_up": F.lit("Does the reading persist in the next release, and is it visible in independent series?")})


def quiet_neighbours(episodes: DataFrame, findings: DataFrame, links: DataFrame, before: int = 14, after: int = 7) -> DataFrame:
    """Related series of an alert that were evaluated around it and did not fire.

    links: topic, series_id. Days name the range, so the join is an equality on (series, day).
    """
    pairs = links.select("topic", "series_id").join(links.select("topic", F.col("series_id").alias("other")), "topic")
    pairs = pairs.where("series_id <> other").select("series_id", "other").distinct()
    key = ["rule_id", "series_id", "episode_start"]
    days = episodes.select(*key, F.explode(F.sequence(F.date_sub("obs_end", before), F.date_add("obs_end", after))).alias("obs_end"))
    seen = findings.select(F.col("series_id").alias("other"), "obs_end", "fired", "explanation")
    j = days.join(pairs, "series_id").join(seen, ["other", "obs_end"])
    best = j.groupBy(*key, "other").agg(F.max(F.struct("fired", "obs_end", "explanation")).alias("b"))
    return best.where("NOT b.fired").select(*key, F.concat(F.col("other"), F.lit(": "), F.col("b.explanation")).alias("text"))


def facet_filter(cards: DataFrame, topics: Sequence[str] = (), kinds: Sequence[str] = (), relationships: Sequence[str] = (),
                 search: str | None = None) -> DataFrame:
    """Cards that share a topic with the chosen ones, of the chosen kinds and outcomes; an empty facet is open."""
    d = cards
    if topics:
        d = d.where(F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics])))
    if kinds:
        d = d.where(F.col("kind").isin(list(kinds)))
    if relationships:
        d = d.where(F.col("relationship").isin(list(relationships)))
    return d.where(F.lower("question").contains(search.lower())) if search else d


def recent_headlines(headlines: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Headlines a card build looks at: discovered lately, or entered by hand."""
    return headlines.where((F.col("discovered_at") >= now - F.expr(f"INTERVAL {days} DAYS")) | (F.col("origin") == "manual"))


