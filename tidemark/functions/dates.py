"""Date and time columns for the providers' formats."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_instant(text: Column) -> Column:
    return F.try_to_timestamp(text)


def compact_instant(text: Column) -> Column:
    """20240131T235959Z; anything else gives null."""
    return F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'"))


def clock_instant(day: Column, hhmm: Column) -> Column:
    """Date text plus an integer like 342 for 03:42."""
    return F.try_to_timestamp(
        F.concat(day.cast("string"), F.lit(" "), F.lpad(hhmm.cast("int").cast("string"), 4, "0")),
        F.lit("yyyy-MM-dd HHmm"))


def any_date(text: Column) -> Column:
    """ISO, d/m/Y or d.m.Y; null when none fits."""
    s = F.substring(F.trim(text.cast("string")), 1, 10)
    return F.coalesce(
        F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d")),
        F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "d/M/yyyy")),
        F.when(s.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(s, "d.M.yyyy")))


def month_start(text: Column) -> Column:
    return F.try_to_date(F.concat(F.substring(text, 1, 7), F.lit("-01")), "yyyy-MM-dd")


def month_end(text: Column) -> Column:
    return F.last_day(month_start(text))


def weekly_start(period_end: Column, measure: Column) -> Column:
    """Flows and rates cover the six days before the period end as well; levels are instants."""
    return F.when(measure.isin("flow", "rate"), F.date_sub(period_end, 6)).otherwise(period_end)


def provider_day(year: Column, month: Column, day: Column, epoch_ms: Column) -> Column:
    """Explicit year, month and day win; a local-midnight epoch is rounded to the nearest day."""
    explicit = F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(),
                      F.make_date(year.cast("int"), month.cast("int"), day.cast("int")))
    rounded = (F.timestamp_millis(epoch_ms.cast("long")) + F.expr("INTERVAL 12 HOURS")).cast("date")
    return F.coalesce(explicit, rounded)


def local_day(ts: Column, zone: str = "Europe/Berlin") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def event_time(published: Column, discovered: Column) -> Column:
    return F.coalesce(published, discovered)


def event_basis(published: Column) -> Column:
    return F.when(published.isNotNull(), "publisher-stated publication time").otherwise(
        "discovery time (publication time not provided)")
