"""Exclusion calendars, inclusion dates and cron fire times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from slipway.functions import values as V, zones as Z

DAY_NAMES = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
LOOKBACK = 3  # fixed number of past inclusion dates


def exclude_times(rows: DataFrame, configs: DataFrame, *, at: str) -> DataFrame:
    """Add ``excluded``: the wall-clock time ``at`` is a weekend or listed date in the schedule's zone."""
    return rows.join(configs, "pipeline_id").withColumn("excluded", Z.excluded_at(F.col("cfg"), F.col(at))).drop("cfg")


def exclude_dates(rows: DataFrame, configs: DataFrame, *, date: str = "exec_date") -> DataFrame:
    """Add ``excluded`` for an execution-date column."""
    return rows.join(configs, "pipeline_id").withColumn(
        "excluded", Z.excluded_date(F.col("cfg"), F.col(date))).drop("cfg")


def exclude_named(rows: DataFrame, configs: DataFrame, calendars: DataFrame, *, date: str = "exec_date") -> DataFrame:
    """Add ``excluded`` by the schedule's named calendar (opt-in; the default exclusions ignore it)."""
    c = calendars.select(F.col("name").alias("_cal"), F.transform("days", F.lower).alias("_days"),
                         F.col("dates").alias("_dates"))
    cfg = configs.select("pipeline_id", F.col("cfg.schedule.calendar").alias("_cal")).join(c, "_cal", "left")
    day = V.valid_date(F.substring(date, 1, 10))
    day_name = F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.dayofweek(day))
    hit = F.array_contains("_days", day_name) | F.array_contains("_dates", F.date_format(day, "yyyy-MM-dd"))
    return rows.join(cfg, "pipeline_id").withColumn("excluded", F.coalesce(hit, F.lit(False))).drop(
        "_cal", "_days", "_dates")


def inclusion_dates(configs: DataFrame, *, now: Column) -> DataFrame:
    """One row per valid inclusion date on or before the day of ``now``."""
    d = configs.select("pipeline_id", F.explode("cfg.schedule.include.dates").alias("exec_date"))
    return d.filter(V.valid_date(F.col("exec_date")).isNotNull() & (F.col("exec_date") <= Z.day_text(now)))


def most_recent_inclusion(configs: DataFrame, *, now: Column) -> DataFrame:
    return inclusion_dates(configs, now=now).groupBy("pipeline_id").agg(F.max("exec_date").alias("exec_date"))


def past_inclusions(configs: DataFrame, *, now: Column) -> DataFrame:
    """The latest three past inclusion dates per pipeline, duplicates counted, with their rank.

    The list lives inside one config row, so the window group is one configuration document.
    """
    w = W.partitionBy("pipeline_id").orderBy(F.col("exec_date").desc())
    return inclusion_dates(configs, now=now).withColumn("rank", F.row_number().over(w)).filter(
        F.col("rank") <= LOOKBACK)


def last_cron_fire(cron: Column, zone: Column, now: Column) -> Column:
    """Last expected fire time (UTC) of a cron text with a plain minute and a plain or ``*`` hour, else NULL."""
    f = F.split(F.trim(cron), r"\s+")
    minute_s, hour_s = F.get(f, F.lit(0)), F.get(f, F.lit(1))
    number = r"^[+-]?\d+$"
    minute = F.when(minute_s.rlike(number), minute_s.try_cast("int"))
    hour = F.when(hour_s.rlike(number), hour_s.try_cast("int"))
    here = Z.to_local(now, zone)
    hourly = hour_s == "*"
    start = F.when(hourly, F.date_trunc("hour", here)).otherwise(F.date_trunc("day", here))
    offset = F.when(hourly, minute * 60).otherwise(hour * 3600 + minute * 60)
    fire = Z.to_utc(Z.plus_seconds(start, offset), zone)
    back = F.when(fire > now, F.when(hourly, -3600).otherwise(-86_400)).otherwise(0)
    return F.when(F.size(f) >= 5, Z.plus_seconds(fire, back))


def last_cron_fires(configs: DataFrame, *, now: Column) -> DataFrame:
    s = F.col("cfg")["schedule"]
    return configs.filter(Z.non_empty(s["cron"])).select(
        "pipeline_id", last_cron_fire(s["cron"], Z.zone_or_utc(s["timezone"]), now).alias("last_fire"))
