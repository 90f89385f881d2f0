"""Bitemporal observation tables: merge, vintage reads, and keyed upserts.

Parquet has no MERGE, so each merge returns the next version of the table; the caller writes it
to a new path (or to the touched partitions) and then switches over.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import same_value
from ..functions.text import short_hash

KEY = ["series_id", "obs_start"]
COLUMNS = ["version_id", "series_id", "obs_start", "obs_end", "value", "status", "source_published_at", "first_seen_at",
           "retrieved_at", "raw_sha256", "revision_no", "is_current", "superseded_at", "attrs"]
TYPES = {"obs_start": "date", "obs_end": "date", "value": "double", "status": "string",
         "source_published_at": "timestamp", "raw_sha256": "string", "attrs": "string"}


def normalise_batch(batch: DataFrame) -> DataFrame:
    """Fill defaults: end = start, NaN = missing, a missing value is never 'ok'."""
    for c, t in TYPES.items():
        batch = batch.withColumn(c, F.col(c).cast(t) if c in batch.columns else F.lit(None).cast(t))
    value = F.when(~F.isnan("value"), F.col("value"))
    batch = batch.withColumn("value", value)
    status = F.coalesce("status", F.when(F.col("value").isNotNull(), "ok").otherwise("missing"))
    return batch.withColumns({
        "obs_end": F.coalesce("obs_end", "obs_start"),
        "status": F.when(F.col("value").isNull() & (status == "ok"), "missing").otherwise(status)})


def duplicate_keys(batch: DataFrame) -> DataFrame:
    """Keys a batch states more than once; a batch with any of them must be refused."""
    return batch.groupBy(*KEY).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def _version_id(rev: Column) -> Column:
    return short_hash(20, F.col("series_id"), F.col("obs_start"), rev, F.col("value"), F.col("status"))


def classify_batch(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Incoming rows joined with the current revision of their key, plus action new/revised/unchanged."""
    cur = current.where("is_current").select(
        *KEY, F.col("value").alias("_v"), F.col("status").alias("_s"), F.col("revision_no").alias("_r"),
        F.col("version_id").alias("_id"))
    rows = normalise_batch(batch).withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(*KEY)))
    twice = F.raise_error(F.concat(F.lit("a batch states a key twice: "), F.concat_ws(" ", *KEY))).cast("double")
    rows = rows.withColumn("value", F.when(F.col("_times") == 1, F.col("value")).otherwise(twice)).drop("_times")
    joined = rows.join(cur, KEY, "left")
    unchanged = same_value(F.col("_v"), F.col("value")) & F.col("_s").eqNullSafe(F.col("status"))
    return joined.withColumn("action", F.when(F.col("_id").isNull(), "new").when(unchanged, "unchanged")
                             .otherwise("revised"))


def merge_observations(current: DataFrame, batch: DataFrame, retrieved_at: Column) -> tuple[DataFrame, DataFrame]:
    """Next version of the table, and counts of new/revised/unchanged rows per series.

    Only the current revisions take part in the join; history is passed through untouched.
    The key is (series, period start), so the shuffle spreads a hot series over all tasks.
    """
    judged = classify_batch(current, batch)
    inserts = (judged.where("action <> 'unchanged'")
               .withColumn("revision_no", (F.coalesce("_r", F.lit(0)) + 1).cast("int"))
               .withColumns({"version_id": _version_id(F.col("revision_no")), "first_seen_at": retrieved_at,
                             "retrieved_at": retrieved_at, "is_current": F.lit(True),
                             "superseded_at": F.lit(None).cast("timestamp")}).select(*COLUMNS))
    closed_ids = judged.where("action = 'revised'").select(*KEY, F.lit(True).alias("_close"))
    live = current.where("is_current").join(closed_ids, KEY, "left").withColumns({
        "superseded_at": F.when(F.col("_close"), retrieved_at).otherwise(F.col("superseded_at")),
        "is_current": F.col("_close").isNull()}).select(*COLUMNS)
    history = current.where("NOT is_current").select(*COLUMNS)
    counts = judged.groupBy("series_id").agg(
        F.count_if(F.col("action") == "new").alias("n_new"),
        F.count_if(F.col("action") == "revised").alias("n_revised"),
        F.count_if(F.col("action") == "unchanged").alias("n_unchanged"))
    return history.unionByName(live).unionByName(inserts), counts


def versions_from_batches(batches: DataFrame, seen_at: str, key: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Full revision history of many batches at once (a backfill): one shuffle instead of one per batch.

    Rows repeating the value and status of the row before them are no-ops. A batch states a key at most once
    (see duplicate_keys), so a key has no more rows here than there were runs.
    """
    key = list(key)
    d = normalise_batch(batches)
    w = Window.partitionBy(*key).orderBy(seen_at)
    same = same_value(F.lag("value").over(w), F.col("value")) & F.lag("status").over(w).eqNullSafe(F.col("status"))
    first = F.row_number().over(w) == 1
    d = d.withColumn("_keep", first | ~same).where("_keep")
    d = d.withColumn("revision_no", F.row_number().over(w).cast("int"))
    nxt = F.lead(seen_at).over(w)
    return d.withColumns({
        "version_id": _version_id(F.col("revision_no")), "first_seen_at": F.col(seen_at),
        "retrieved_at": F.col(seen_at), "superseded_at": nxt, "is_current": nxt.isNull()}).drop("_keep")


def absorb_batches(current: DataFrame, rows: DataFrame, seen_at: str) -> DataFrame:
    """Next version of the table after rows of any number of batches, each stamped with when it was seen.

    What a stream needs: one micro-batch may hold several revisions of a key, repeats, or rows already stored. Rows of a key
    are laid in the order they were seen, each is compared with the last one kept, and no-ops fall away. A row seen before
    the current revision takes its place in the history, as if it had come in time: only then are older revisions read.
    """
    shown = ["value", "status", "obs_end", "source_published_at", "raw_sha256", "attrs"]
    stored = [F.col("first_seen_at").alias("_seen"), F.col("revision_no").alias("_rev"), F.col("retrieved_at").alias("_ret")]
    new = normalise_batch(rows).select(*KEY, *shown, F.col(seen_at).alias("_seen"), F.lit(None).cast("int").alias("_rev"), F.col(seen_at).alias("_ret"))
    live, history = current.where("is_current"), current.where("NOT is_current")
    late = new.join(live.select(*KEY, F.col("first_seen_at").alias("_since")), KEY).where("_seen < _since").select(*KEY).distinct()
    base = live.unionByName(history.join(late, KEY, "left_semi")).select(*KEY, *shown, *stored)
    entry = F.struct("_seen", F.col("_rev").isNull().alias("_new"), *shown, "_rev", "_ret")
    keys = base.unionByName(new).groupBy(*KEY).agg(F.coalesce(F.min("_rev"), F.lit(1)).alias("_first"), F.array_sort(F.collect_list(entry)).alias("_rows"))

    def follow(kept: Column, row: Column) -> Column:
        last = F.element_at(kept, -1)
        repeat = (last["_seen"] == row["_seen"]) & row["_new"] & ~last["_new"]
        same = same_value(last["value"], row["value"]) & last["status"].eqNullSafe(row["status"])
        return F.when((F.size(kept) > 0) & (repeat | same), kept).otherwise(F.concat(kept, F.array(row)))

    kept = keys.select(*KEY, "_first", F.aggregate("_rows", F.slice("_rows", 1, 0), follow).alias("_kept"))
    d = kept.select(*KEY, "_first", "_kept", F.posexplode("_kept").alias("_at", "_r")).select(
        *KEY, *[F.col(f"_r.{c}").alias(c) for c in shown], (F.col("_first") + F.col("_at")).cast("int").alias("revision_no"),
        F.col("_r._seen").alias("first_seen_at"), F.col("_r._ret").alias("retrieved_at"), F.try_element_at("_kept", F.col("_at") + 2)["_seen"].alias("superseded_at"))
    d = d.withColumn("is_current", F.col("superseded_at").isNull()).withColumn("version_id", _version_id(F.col("revision_no"))).select(*COLUMNS)
    return history.join(late, KEY, "left_anti").select(*COLUMNS).unionByName(d)


def observations(versions: DataFrame, as_of: Column | None = None, current_only: bool = True) -> DataFrame:
    """Current rows, everything, or what was known at an instant. A plain filter that reaches the scan."""
    if as_of is not None:
        return versions.where((F.col("first_seen_at") <= as_of)
                              & (F.col("superseded_at").isNull() | (F.col("superseded_at") > as_of)))
    return versions.where("is_current") if current_only else versions


# ------------------------------------------------------------------ keyed tables
def upsert_latest(current: DataFrame, incoming: DataFrame, key: Sequence[str], overwrite: Sequence[str],
                  keep_when_empty: Sequence[str] = (), fill_once: Sequence[str] = (), earliest: Sequence[str] = ()) -> DataFrame:
    """Type-1 upsert with a rule per column.

    overwrite: the new value wins; keep_when_empty: an empty new value erases nothing;
    fill_once: only a missing value is filled; earliest: the smaller value stays;
    every other column keeps the stored value. Both sides hold one row per key.
    """
    key = list(key)
    old = current.select(*key, F.struct(*[c for c in current.columns if c not in key]).alias("_o"))
    new = incoming.select(*key, F.struct(*[c for c in incoming.columns if c not in key]).alias("_n"))
    j = old.join(new, key, "full_outer")
    known = F.col("_o").isNotNull()
    cols = []
    for c in current.columns:
        if c in key:
            continue
        o, n = F.col("_o")[c], F.col("_n")[c]
        if c in overwrite:
            v = F.when(F.col("_n").isNotNull(), n).otherwise(o)
        elif c in keep_when_empty:
            v = F.coalesce(F.nullif(n, F.lit("")), o)
        elif c in fill_once:
            v = F.coalesce(o, n)
        elif c in earliest:
            v = F.least(o, n)
        else:
            v = F.when(known, o).otherwise(n)
        cols.append(v.alias(c))
    return j.select(*key, *cols)


def insert_if_absent(current: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Append rows whose key is new; repeats inside the batch count once."""
    fresh = incoming.dropDuplicates(list(key)).join(current.select(*key), list(key), "left_anti")
    return current.unionByName(fresh)


def replace_by_key(current: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert-or-replace: incoming rows take the place of stored rows with the same key."""
    return current.join(incoming.select(*key), list(key), "left_anti").unionByName(incoming)


def update_if_newer(current: DataFrame, incoming: DataFrame, key: Sequence[str], stamp: str,
                    columns: Sequence[str]) -> DataFrame:
    """Take the listed columns from incoming rows with a later stamp; unknown keys are inserted whole."""
    key = list(key)
    new = incoming.select(*key, *[F.col(c).alias("_n_" + c) for c in [stamp, *columns]])
    j = current.join(new, key, "left")
    newer = F.col("_n_" + stamp) > F.col(stamp)
    updated = j.select(*[
        F.when(newer, F.col("_n_" + c)).otherwise(F.col(c)).alias(c) if c in (stamp, *columns) else F.col(c)
        for c in current.columns])
    return updated.unionByName(incoming.join(current.select(*key), key, "left_anti").select(*current.columns))


def apply_decisions(items: DataFrame, decisions: DataFrame, key: str, status: str) -> DataFrame:
    """Review decisions override a status; items nobody decided on keep theirs."""
    d = decisions.select(key, F.col("decision").alias("_d"))
    return items.join(d, key, "left").withColumn(status, F.coalesce("_d", status)).drop("_d")


def raw_manifest(files: DataFrame, manifest: DataFrame | None, source: str) -> DataFrame:
    """sha256-addressed rows of a binaryFile scan; content already listed is not listed again."""
    rows = files.select(
        F.sha2("content", 256).alias("sha256"), F.lit(source).alias("source"), F.col("path").alias("url"),
        F.col("modificationTime").alias("retrieved_at"), F.col("length").alias("size"))
    rows = latest_manifest(rows)
    if manifest is None:
        return rows
    return manifest.unionByName(rows.join(manifest.select("sha256"), "sha256", "left_anti"))


def latest_manifest(rows: DataFrame) -> DataFrame:
    names = [c for c in rows.columns if c != "sha256"]
    return (rows.groupBy("sha256").agg(F.min_by(F.struct(*names), F.struct("retrieved_at", "url")).alias("_r"))
            .select("sha256", *[F.col("_r")[n].alias(n) for n in names]))


def has_changes(counts: DataFrame) -> bool:
    """Gate for dependent work: did a merge store any new or revised row? One tiny aggregate."""
    r = counts.agg(F.coalesce(F.sum(F.col("n_new") + F.col("n_revised")), F.lit(0)).alias("n")).first()
    return bool(r["n"])
