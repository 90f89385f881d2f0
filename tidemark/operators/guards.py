"""Data guards: checks that stop a job, runs that are read once and judged, and functions that return offending rows."""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import PROVIDER_UNITS
from ..session import scratch_path
from .quantiles import group_quantiles


class SourceChanged(ValueError):
    """A provider's layout, unit or licence is not what the reader was built for."""


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise SourceChanged(f"{what} lacks columns {missing}; it has {df.columns[:12]}")
    return df


def require_none(bad: DataFrame, message: str) -> None:
    """Raise with a few examples if a violations query returns rows. Reads at most five rows."""
    rows = bad.limit(5).collect()
    if rows:
        raise SourceChanged(f"{message}: {[r.asDict() for r in rows]}")


def assert_each(df: DataFrame, ok: Column, message: Column) -> DataFrame:
    """Fail inside the running query at the first row that breaks the condition (unknown passes); no extra pass.

    The check is a filter, so it is evaluated whichever columns the query goes on to read, and when it only counts. Rows that
    a later filter takes away may leave before they are checked.
    """
    refuse = F.raise_error(F.concat(F.lit("SourceChanged: "), message)).cast("boolean")
    return df.where(F.when(F.coalesce(ok, F.lit(True)), F.lit(True)).otherwise(refuse))


@dataclass(frozen=True)
class Run:
    """One ingestion run: what became of it, and what its only pass over the source counted."""
    status: str
    n_rows: int = 0
    latest: object = None
    broken: dict = field(default_factory=dict)      # rows or groups that break each check
    message: str | None = None
    table: DataFrame | None = None                  # what was read, only if the run is ok


def guarded_run(df: DataFrame, name: str, rows: dict[str, Column] | None = None, groups: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
                at: str = "obs_end", changed: Callable[[DataFrame], bool] | None = None) -> Run:
    """Read a source once, into the shared folder, and say whether it may be used.

    ``rows`` are conditions on a row: how many rows break them is counted by the write itself. ``groups`` give the violations
    among the rows read (medians, totals, repeated keys); they look at the written columns they need, not at the source.
    Any violation, and any check inside the reader, makes the run ``schema_changed``; other errors make it ``failed``.
    ``changed`` tells whether the rows hold anything new; without, the run is ``not_modified``.
    """
    rows, path = rows or {}, scratch_path(df.sparkSession, name)
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    bad = {k: F.count_if(~F.coalesce(ok, F.lit(True))).alias(f"bad_{k}") for k, ok in rows.items()}
    newest = [F.max(at).alias("latest")] if at in df.columns else []
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *newest, *bad.values()).write.parquet(path)
        found = seen.get
        table = df.sparkSession.read.schema(df.schema).parquet(path)
        broken = {k: found[f"bad_{k}"] for k in rows} | {k: check(table).count() for k, check in (groups or {}).items()}
        if any(broken.values()):
            said = "; ".join(f"{n} break {k}" for k, n in broken.items() if n)
            return Run("schema_changed", found["n_rows"], found.get("latest"), broken, f"SourceChanged: {said}")
        status = run_status(None, changed is None or changed(table), changed is not None)
        return Run(status, found["n_rows"], found.get("latest"), broken, None, table)
    except (PySparkException, SourceChanged) as e:
        said = re.search(r"SourceChanged: [^\n]*", str(e))
        message = said.group() if said else f"SourceChanged: {e}" if isinstance(e, SourceChanged) else f"{type(e).__name__}: {e}"
        return Run(run_status(message, False), message=message[:2000])


def batch_report(df: DataFrame, by: Sequence[str], key: Sequence[str], checks: dict[str, Column], previous: DataFrame | None = None, mark: Sequence[str] = ()) -> DataFrame:
    """Every batch of a table judged at once: per ``by`` its rows, how many break each check, how many keys it states twice,
    and its status.

    ``previous`` holds (by, digest) of what was last read; a batch with that digest over ``mark`` is ``not_modified``. One row
    per key and batch after the first, partial aggregation, so a large batch spreads over all tasks.
    """
    hashes = F.xxhash64(*mark).cast("decimal(38,0)") if mark else F.lit(0).cast("decimal(38,0)")
    per_key = df.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("_n"), F.sum(hashes).alias("_h"),
                                        *[F.count_if(~F.coalesce(ok, F.lit(True))).alias(f"bad_{k}") for k, ok in checks.items()])
    out = per_key.groupBy(*by).agg(F.sum("_n").alias("n_rows"), F.count_if(F.col("_n") > 1).alias("n_repeated"), F.sum("_h").alias("digest"),
                                   *[F.sum(f"bad_{k}").alias(f"bad_{k}") for k in checks])
    wrong = reduce(lambda a, b: a | b, [F.col(f"bad_{k}") > 0 for k in checks], F.col("n_repeated") > 0)
    same = F.lit(False)
    if previous is not None:
        out = out.join(previous.select(*by, F.col("digest").alias("_old")), list(by), "left")
        same = F.coalesce(F.col("_old") == F.col("digest"), F.lit(False))
    out = out.withColumn("status", F.when(wrong, "schema_changed").when(same, "not_modified").otherwise("ok"))
    return out.drop("_old") if previous is not None else out


def unit_fits(unit: str, provider_unit: str) -> Column:
    """Whether the provider's unit belongs to the engine's; null where either is unknown."""
    allowed = F.create_map(*[x for k, v in PROVIDER_UNITS.items()
                             for x in (F.lit(k), F.array(*[F.lit(u) for u in v]))])
    return F.array_contains(F.try_element_at(allowed, F.col(unit)), F.col(provider_unit))


def unit_violations(df: DataFrame, unit: str, provider_unit: str) -> DataFrame:
    """Rows whose provider unit does not belong to the engine unit."""
    return df.where(F.coalesce(~unit_fits(unit, provider_unit), F.lit(False)))


def magnitude_violations(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float) -> DataFrame:
    """Groups whose median lies outside the plausible range; a group of any size is only counted, never gathered."""
    return group_quantiles(df, keys, value, {"median": 0.5}).where(~F.col("median").between(lo, hi)).drop("n")


def total_violations(pages: DataFrame, key: Sequence[str], declared: str, rows_on_page: str) -> DataFrame:
    """Paged responses whose rows do not add up to the declared total."""
    t = pages.groupBy(*key).agg(F.max(declared).alias("declared"), F.sum(rows_on_page).alias("read"))
    return t.where(~F.col("declared").eqNullSafe(F.col("read")))


def unit_mix_violations(df: DataFrame, export: str, unit: str) -> DataFrame:
    """Exports that put snapshot counts beside per-day units, or label a snapshot count per day."""
    u = F.lower(unit)
    snap, flow = u.contains("snapshot"), u.contains("per day") | u.contains("transit")
    g = df.groupBy(export).agg(F.bool_or(snap).alias("has_snapshot"), F.bool_or(flow & ~snap).alias("has_daily"),
                               F.bool_or(flow & snap).alias("mislabelled"))
    return g.where((F.col("has_snapshot") & F.col("has_daily")) | F.col("mislabelled"))


def licence_violations(df: DataFrame, licence: str, must_contain: str = "CC BY") -> DataFrame:
    return df.where((F.coalesce(licence, F.lit("")) != "") & ~F.upper(licence).contains(must_contain))


#: What a run came to, by the kind of error that ended it.
STATUS_OF = {"SourceChanged": "schema_changed", "NotConfigured": "unconfigured", "ConnectorStopped": "stopped", "RateLimited": "paused", "CircuitOpen": "paused",
             "NetworkUnavailable": "unavailable", "PolicyDenied": "denied"}


def run_status(error: str | None, changed: bool, seen_before: bool = False, enabled: bool = True) -> str:
    """Status of one ingestion run for the ledger; ``error`` starts with its kind."""
    if not enabled:
        return "disabled"
    if error:
        return STATUS_OF.get(re.match(r"\w*", error).group(), "failed")
    return "not_modified" if seen_before and not changed else "ok"


def run_statuses(error: str | Column, changed: Column, enabled: Column | None = None) -> Column:
    """``run_status`` over a table of landed attempts."""
    error = F.col(error) if isinstance(error, str) else error
    kinds = F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv])
    kind = F.coalesce(F.try_element_at(kinds, F.regexp_extract(error, r"^(\w*)", 1)), F.lit("failed"))
    status = F.when(F.coalesce(error, F.lit("")) != "", kind).when(changed, "ok").otherwise("not_modified")
    return status if enabled is None else F.when(enabled, status).otherwise("disabled")
