"""Finding store, alert episodes and content-versioned cards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SUPPRESS_DAYS
from ..functions.text import short_hash
from ..session import cut_lineage

BUSINESS_KEY = ["rule_id", "series_id", "obs_start"]


def finding_id(as_of: Column) -> Column:
    return short_hash(20, F.col("rule_id"), F.col("series_id"), F.col("obs_start"), F.col("formula_version"),
                      F.array_join("input_version_ids", ","), as_of)


def store_findings(stored: DataFrame, findings: DataFrame, now: Column, as_of: Column | None = None,
                   suppress_days: int = SUPPRESS_DAYS) -> DataFrame:
    """Next version of the finding table.

    The same rule on the same inputs has the same id and changes nothing. New inputs supersede the
    active row of (rule, series, period). A fired row within ``suppress_days`` of the previous active
    fired row of its rule and series continues that alert at a quarter of the severity. Replays of an
    older vintage (``as_of``) are kept apart and touch nothing.
    """
    stamp = as_of if as_of is not None else F.lit(None).cast("timestamp")
    new = findings.withColumn("anomaly_id", finding_id(stamp)).withColumns({
        "status": F.lit("replay" if as_of is not None else "active"), "created_at": now, "as_of": stamp,
        "superseded_at": F.lit(None).cast("timestamp"), "superseded_by": F.lit(None).cast("string"),
        "continuation_of": F.lit(None).cast("string")})
    new = new.join(stored.select("anomaly_id"), "anomaly_id", "left_anti").select(*stored.columns)
    if as_of is not None:
        return stored.unionByName(new)
    successor = new.select(*BUSINESS_KEY, F.col("anomaly_id").alias("_by"))
    kept = stored.join(successor, BUSINESS_KEY, "left")
    closed = F.col("_by").isNotNull() & (F.col("status") == "active") & F.col("as_of").isNull()
    kept = kept.withColumns({
        "superseded_at": F.when(closed, now).otherwise(F.col("superseded_at")),
        "superseded_by": F.when(closed, F.col("_by")).otherwise(F.col("superseded_by")),
        "status": F.when(closed, "superseded").otherwise(F.col("status"))}).select(*stored.columns)
    both = kept.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    # One active row per (rule, series, day): the alert history of a series is bounded by the calendar.
    alert = F.col("fired") & (F.col("status") == "active")
    w = Window.partitionBy("rule_id", "series_id", "_alert").orderBy("obs_start")
    both = both.withColumn("_alert", alert)
    near = F.datediff("obs_start", F.lag("obs_start").over(w)) <= suppress_days
    both = both.withColumn("_cont", F.when(F.col("_new") & F.col("_alert") & near, F.lag("anomaly_id").over(w)))
    return both.withColumns({
        "continuation_of": F.coalesce("_cont", "continuation_of"),
        "severity_rank": F.when(F.col("_cont").isNotNull(), F.col("severity_rank") * 0.25)
        .otherwise(F.col("severity_rank")),
        "explanation": F.when(F.col("_cont").isNotNull(), F.concat(
            F.col("explanation"), F.lit(" (continuation of alert "), F.col("_cont"),
            F.lit(", ranked lower)"))).otherwise(F.col("explanation")),
    }).select(*stored.columns)


def mark_unscreened(stored: DataFrame, screened: DataFrame, group: Column, now: Column) -> DataFrame:
    """Active findings whose group is no longer screened keep their history under another status."""
    s = screened.select(F.col("group_key").alias("_g"), F.lit(True).alias("_s")).distinct()
    out = stored.withColumn("_g", group).join(s, "_g", "left")
    gone = F.col("_s").isNull() & F.col("_g").isNotNull() & (F.col("status") == "active") & F.col("as_of").isNull()
    return out.withColumns({"superseded_at": F.when(gone, now).otherwise(F.col("superseded_at")),
                            "status": F.when(gone, "not_screened").otherwise(F.col("status"))}).select(*stored.columns)


def resolve_root(links: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """Root of every id by pointer doubling: a chain of length n takes log2(n) joins.

    Each round is checkpointed, so lineage stays short and a lost executor costs one round.
    A cycle never ends: after the rounds that the longest possible chain needs it is reported as an error.
    """
    cur = links.select(F.col(id_col), F.coalesce(parent_col, id_col).alias("root"))
    rounds = cur.count().bit_length() + 1
    for _ in range(rounds + 1):
        hop = cur.select(F.col(id_col).alias("root"), F.col("root").alias("_next"))
        nxt = cur.join(hop, "root", "left").select(
            id_col, F.coalesce("_next", "root").alias("root"),
            (F.col("_next").isNotNull() & (F.col("_next") != F.col("root"))).alias("_moved"))
        nxt = cut_lineage(nxt)
        moved = nxt.where("_moved").limit(1).count()
        cur = nxt.drop("_moved")
        if not moved:
            return cur
    raise ValueError(f"{parent_col} links form a cycle")


def alert_episodes(findings: DataFrame, suppress_days: int = SUPPRESS_DAYS) -> DataFrame:
    """Fired findings with the first alert of their episode; alerts at most suppress_days apart belong together."""
    w = Window.partitionBy("rule_id", "series_id").orderBy("obs_start")
    starts = F.coalesce(F.datediff("obs_start", F.lag("obs_start").over(w)) > suppress_days, F.lit(True))
    d = findings.where("fired").withColumn("_starts", starts)
    root = F.last(F.when(F.col("_starts"), F.col("obs_start")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("episode_start", root).drop("_starts")


def latest_of_episode(episodes: DataFrame) -> DataFrame:
    names = [c for c in episodes.columns if c not in ("rule_id", "series_id", "episode_start")]
    return (episodes.groupBy("rule_id", "series_id", "episode_start")
            .agg(F.max_by(F.struct(*names), "obs_start").alias("_r"), F.count("*").alias("n_alerts"))
            .select("rule_id", "series_id", "episode_start", "n_alerts", *[F.col("_r")[n].alias(n) for n in names]))


# ------------------------------------------------------------------ cards
def content_hash(columns: list[str]) -> Column:
    """Hash over the listed columns in sorted order: same evidence, same hash."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 20)


def store_cards(stored: DataFrame, cards: DataFrame, content: list[str], now: Column,
                withdraw_kinds: list[str] = ()) -> DataFrame:
    """Next version of the card table (card_id, version, status, content_hash, created_at, ...).

    Unchanged content keeps its version; changed content adds version + 1 and supersedes the old one.
    Current cards of the listed kinds that were not produced this time become 'withdrawn'.
    """
    new = cards.withColumn("content_hash", content_hash(content))
    cur = stored.where("status = 'current'").select(
        "card_id", F.col("version").alias("_v"), F.col("content_hash").alias("_h"))
    judged = new.join(cur, "card_id", "left")
    inserts = judged.where(F.col("_h").isNull() | (F.col("_h") != F.col("content_hash"))).withColumns({
        "version": (F.coalesce("_v", F.lit(0)) + 1).cast("int"), "status": F.lit("current"), "created_at": now})
    inserts = inserts.select(*stored.columns)
    changed = inserts.select("card_id", F.lit(True).alias("_changed"))
    produced = cards.select("card_id", F.lit(True).alias("_made")).distinct()
    is_cur = F.col("status") == "current"
    kept = stored.join(changed, "card_id", "left").join(produced, "card_id", "left").withColumn(
        "status", F.when(is_cur & F.col("_changed").isNotNull(), "superseded")
        .when(is_cur & F.col("_made").isNull() & F.col("kind").isin(list(withdraw_kinds)), "withdrawn")
        .otherwise(F.col("status"))).select(*stored.columns)
    return kept.unionByName(inserts)


def build_cards(stored: DataFrame, cards: DataFrame, content: list[str], now: Column, complete_kinds: list[str] = (),
                considered: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One build over cards of all kinds: the next table, and (card_id, kind, outcome) of every card it judged.

    A full outer join of each card's newest stored version with the cards produced answers at once what became of it: ``new``,
    ``same``, ``changed`` (the old version is superseded), ``withdrawn``, or ``returned`` after a withdrawal, which continues the
    numbering. A current card that was not produced is withdrawn if its kind is in ``complete_kinds`` (a build produces all
    of them) or its card_id is in ``considered`` (it was looked at and no longer qualifies); otherwise it stays. A build produces
    a card_id once at most. History passes through untouched.
    """
    new = cards.withColumn("content_hash", content_hash(content))
    held = stored.groupBy("card_id").agg(F.max_by(F.struct("version", "status", F.col("content_hash").alias("hash"), "kind"), "version").alias("_held"))
    made = new.select("card_id", F.struct("kind", F.col("content_hash").alias("hash")).alias("_made"))
    both = held.join(made, "card_id", "full_outer")
    looked = F.col("_held.kind").isin(list(complete_kinds))
    if considered is not None:
        both = both.join(considered.select("card_id", F.lit(True).alias("_looked")).distinct(), "card_id", "left")
        looked = looked | F.coalesce("_looked", F.lit(False))
    current = F.col("_held.status") == "current"
    outcome = (F.when(F.col("_made").isNull(), F.when(current & looked, "withdrawn"))
               .when(F.col("_held").isNull(), "new").when(~current, "returned").when(F.col("_held.hash") == F.col("_made.hash"), "same").otherwise("changed"))
    judged = cut_lineage(both.select("card_id", F.coalesce("_made.kind", "_held.kind").alias("kind"), outcome.alias("outcome"), F.col("_held.version").alias("_v")).where("outcome IS NOT NULL"))
    inserts = new.join(judged.where("outcome IN ('new', 'changed', 'returned')").select("card_id", "_v"), "card_id").withColumns({
        "version": (F.coalesce("_v", F.lit(0)) + 1).cast("int"), "status": F.lit("current"), "created_at": now})
    closing = judged.where("outcome IN ('changed', 'withdrawn')").select("card_id", F.when(F.col("outcome") == "changed", "superseded").otherwise("withdrawn").alias("_status"))
    is_current = F.col("status") == "current"
    closed = stored.where(is_current).join(closing, "card_id", "left").withColumn("status", F.coalesce("_status", "status"))
    table = stored.where(~is_current).unionByName(closed.select(*stored.columns)).unionByName(inserts.select(*stored.columns))
    return table, judged.select("card_id", "kind", "outcome")


def build_counts(outcomes: DataFrame) -> DataFrame:
    """Per kind how many cards a build produced, how many versions it added, and how many it withdrew."""
    o = F.col("outcome")
    return outcomes.groupBy("kind").agg(F.count_if(o != "withdrawn").alias("n_cards"), F.count_if(o.isin("new", "changed", "returned")).alias("new_versions"),
                                        F.count_if(o == "withdrawn").alias("withdrawn"), F.count_if(o == "returned").alias("returned"))


def card_history(batches: DataFrame, seen_at: str, content: list[str]) -> DataFrame:
    """All card versions of a sequence of builds at once: a version starts where the content hash changes."""
    d = batches.withColumn("content_hash", content_hash(content))
    w = Window.partitionBy("card_id").orderBy(seen_at)
    d = d.withColumn("_prev", F.lag("content_hash").over(w))
    d = d.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("content_hash"))).drop("_prev")
    nxt = F.lead(seen_at).over(w)
    return d.withColumns({"version": F.row_number().over(w).cast("int"),
                          "status": F.when(nxt.isNull(), "current").otherwise("superseded")})
