"""Time zones, execution dates and exclusion tests as column expressions."""

from __future__ import annotations

import functools
import zoneinfo

from pyspark.sql import Column, functions as F

from slipway.functions import values as V


@functools.cache
def plain_zone_names() -> tuple[str, ...]:
    """Zone names without a region prefix (UTC, EST5EDT, ...)."""
    not_zones = {"Factory", "localtime", "posixrules"}
    return tuple(sorted(n for n in zoneinfo.available_timezones() - not_zones if "/" not in n))


def is_zone(tz: Column) -> Column:
    """A known zone name. Conversion functions fail on unknown names, so every use is guarded by this.

    Region names are tried in a timestamp text, which gives NULL for unknown ones without listing them.
    """
    region = tz.contains("/") & F.concat(F.lit("2020-01-01 00:00:00 "), tz).try_cast("timestamp").isNotNull()
    return F.coalesce(tz.isin(*plain_zone_names()) | region, F.lit(False))


def zone_or_utc(tz: Column) -> Column:
    return F.when(is_zone(tz), tz).otherwise(F.lit("UTC"))


def to_local(ts: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(ts, zone)


def to_utc(local: Column, zone: Column) -> Column:
    """Local wall time to UTC, with the reference's choice inside daylight-saving folds and gaps.

    The offset used is the one in force at (local - offset in force at local read as UTC).
    """
    us = F.unix_micros(local)
    guess = us + us - F.unix_micros(F.from_utc_timestamp(local, zone))
    return F.timestamp_micros(us + guess - F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(guess), zone)))


def plus_seconds(ts: Column, seconds: Column | float) -> Column:
    s = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return F.timestamp_micros(F.unix_micros(ts) + F.round(s * 1e6).cast("bigint"))


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def midnight(d: Column) -> Column:
    return d.cast("timestamp")


def date_part(exec_date: Column) -> Column:
    return F.split_part(exec_date, F.lit("T"), F.lit(1))


def hour_part(exec_date: Column) -> Column:
    """Text after the first ``T``; empty for a daily execution date."""
    at = F.locate("T", exec_date)
    return F.when(at > 0, exec_date.substr(at + 1, F.length(exec_date))).otherwise(F.lit(""))


def execution_date(data: Column, now: Column) -> Column:
    """Execution date of a sensor row from its ``date`` and ``hour`` text fields, else the day of ``now``."""
    date_s = F.coalesce(V.text(V.field(data, F.lit("date"))), F.lit(""))
    hour_s = F.coalesce(V.text(V.field(data, F.lit("hour"))), F.lit(""))
    return execution_date_of(date_s, hour_s, now)


def execution_date_of(date_s: Column, hour_s: Column, now: Column) -> Column:
    compact = (F.length(date_s) == 8) & ~date_s.contains("-")
    dashed = F.when(
        compact,
        F.concat_ws("-", F.substring(date_s, 1, 4), F.substring(date_s, 5, 2), F.substring(date_s, 7, 2)),
    ).otherwise(date_s)
    good_hour = hour_s.rlike("^([01][0-9]|2[0-3])$")
    return (
        F.when(V.valid_date(dashed).isNull(), day_text(now))
        .when(good_hour, F.concat(dashed, F.lit("T"), hour_s))
        .otherwise(dashed)
    )


def _on_excluded_day(exclude: Column, day: Column) -> Column:
    weekend = exclude["weekends"] & F.dayofweek(day).isin(1, 7)
    listed = F.array_contains(exclude["dates"], F.date_format(day, "yyyy-MM-dd"))
    return F.coalesce(weekend, F.lit(False)) | F.coalesce(listed, F.lit(False))


def excluded_at(cfg: Column, now: Column) -> Column:
    """Wall-clock exclusion of ``now`` in the schedule's zone (as given when no zone is set)."""
    schedule = cfg["schedule"]
    zone = zone_or_utc(schedule["timezone"])
    return F.coalesce(_on_excluded_day(schedule["exclude"], to_local(now, zone)), F.lit(False))


def excluded_date(cfg: Column, exec_date: Column) -> Column:
    """Calendar exclusion of an execution date; too short or invalid dates are not excluded."""
    day = V.valid_date(F.substring(exec_date, 1, 10))
    return F.coalesce(_on_excluded_day(cfg["schedule"]["exclude"], day), F.lit(False))


def non_empty(s: Column) -> Column:
    return F.coalesce(s != "", F.lit(False))


def schedule_id(cfg: Column) -> Column:
    return F.when(non_empty(cfg["schedule"]["cron"]), F.lit("cron")).otherwise(F.lit("stream"))
