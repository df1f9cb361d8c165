"""Deadlines, alerts due, suppression, verdicts and projections for every run at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipway.functions import values as V, zones as Z
from slipway.functions.ordered import earliest_by, latest_by, once
from slipway.schema import FINISHED, RUN_KEY, TERMINAL_EVENTS

HOUR, DAY = 3600, 86_400


def absolute_deadline(df: DataFrame, *, now: Column, date: str = "exec_date", deadline: str = "deadline",
                      expected: str = "expected_duration", timezone: str = "sla_timezone") -> DataFrame:
    """Add ``breach_at``, ``warning_at`` and ``deadline_error``.

    ``HH:MM`` is that local time of the date and rolls 24 hours on when already past. ``:MM`` is a minute of the
    execution hour plus one hour for an hourly date, or of the current local hour for a daily date (one hour on
    when past). An unparseable date means the local day of ``now``. Rolling adds absolute hours, not days.
    """
    c, tz = F.col, F.col(timezone)
    tz_ok = ~V.non_null_text(tz) | Z.is_zone(tz)
    steps = df.withColumns({
        "_zone": Z.zone_or_utc(tz), "_now": now, "_exp": V.duration_seconds(F.coalesce(expected, F.lit(""))),
        "_day": V.valid_date(Z.date_part(F.coalesce(date, F.lit("")))),
        "_hour": Z.hour_part(F.coalesce(date, F.lit(""))),
    }).withColumn("_lnow", Z.to_local(c("_now"), c("_zone")))
    hourly = c("_day").isNotNull() & (c("_hour") != "")
    hour_no = F.when(c("_hour").rlike(r"^[+-]?\d+$"), c("_hour").try_cast("int"))
    base_day = F.coalesce(Z.midnight(c("_day")), F.date_trunc("day", "_lnow"))
    base = F.when(hourly, Z.plus_seconds(base_day, F.coalesce(hour_no, F.lit(0)) * HOUR)).otherwise(
        Z.plus_seconds(base_day, F.hour("_lnow") * HOUR))
    dl = F.coalesce(F.col(deadline), F.lit(""))
    minute_form, clock_form = dl.rlike(r"^:[0-5]\d$"), dl.rlike(r"^(\d|[01]\d|2[0-3]):[0-5]\d$")
    minutes = F.regexp_extract(dl, r":(\d\d)$", 1).try_cast("int")
    hours = F.regexp_extract(dl, r"^(\d+):", 1).try_cast("int")
    local = F.when(minute_form, Z.plus_seconds(base, minutes * 60)).when(
        clock_form, Z.plus_seconds(F.date_trunc("day", base), hours * HOUR + minutes * 60))
    steps = once(steps, {"_local": local, "_hourly": hourly & hour_no.isNotNull() & (hour_no >= 0), "_by_minute": minute_form,
                         "_good": tz_ok})
    steps = once(steps, {"_due": Z.to_utc(c("_local"), c("_zone"))})
    past = c("_due") < c("_now")
    roll = F.when(c("_by_minute"), F.when(c("_hourly") | past, HOUR)).when(past, DAY)
    error = F.when(c("_exp").isNull(), "bad_duration").when(~c("_good"), "bad_timezone").when(
        c("_local").isNull(), "bad_deadline")
    out = steps.withColumns({
        "deadline_error": error,
        "breach_at": F.when(error.isNull(), Z.plus_seconds(c("_due"), F.coalesce(roll, F.lit(0)))),
    }).withColumn("warning_at", Z.plus_seconds(c("breach_at"), -c("_exp")))
    return out.drop("_zone", "_now", "_exp", "_day", "_hour", "_lnow", "_due", "_local", "_hourly",
                    "_by_minute", "_good")


def relative_deadline(df: DataFrame, *, arrival: str = "arrival_at", max_duration: str = "max_duration",
                      expected: str = "expected_duration") -> DataFrame:
    """Add ``breach_at`` = arrival + maximum and ``warning_at`` = breach - expected (or a quarter of the maximum)."""
    limit = V.duration_seconds(F.col(max_duration))
    has_expected = V.non_null_text(F.col(expected))
    offset = F.when(has_expected, V.duration_seconds(F.col(expected))).otherwise(limit / 4)
    error = F.when(limit.isNull(), "bad_max_duration").when(F.col(arrival).isNull(), "bad_arrival").when(
        offset.isNull(), "bad_duration")
    return df.withColumns({
        "deadline_error": error, "breach_at": F.when(error.isNull(), Z.plus_seconds(F.col(arrival), limit)),
        "warning_at": F.when(error.isNull(), Z.plus_seconds(F.col(arrival), limit - offset)),
    })


def deadlines(df: DataFrame, *, now: Column) -> DataFrame:
    """Relative deadline when a maximum and an arrival are present, else absolute; ``deadline_kind`` tells which."""
    relative = V.non_null_text(F.col("max_duration")) & F.col("arrival_at").isNotNull()
    a = absolute_deadline(df, now=now).withColumnsRenamed(
        {"breach_at": "_ab", "warning_at": "_aw", "deadline_error": "_ae"})
    both = relative_deadline(a)
    pick = {"breach_at": "_ab", "warning_at": "_aw", "deadline_error": "_ae"}
    return both.withColumns({
        **{k: F.when(relative, F.col(k)).otherwise(F.col(v)) for k, v in pick.items()},
        "deadline_kind": F.when(relative, "relative").otherwise("absolute"),
    }).drop(*pick.values())


def sla_runs(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """Runs of pipelines with an SLA, with its texts as columns."""
    s = F.col("cfg")["sla"]
    c = configs.filter(s.isNotNull()).select(
        "pipeline_id", s["deadline"].alias("deadline"), s["expectedDuration"].alias("expected_duration"),
        s["maxDuration"].alias("max_duration"), s["timezone"].alias("sla_timezone"))
    return runs.join(c, "pipeline_id")


def reconcile(with_deadlines: DataFrame, *, now: Column) -> DataFrame:
    """Add ``alert_type`` by comparing ``now`` with warning and breach, both inclusive; errors stay NULL."""
    kind = F.when(now >= F.col("breach_at"), "SLA_BREACH").when(now >= F.col("warning_at"), "SLA_WARNING").otherwise(
        "SLA_MET")
    return with_deadlines.withColumn("alert_type", F.when(F.col("breach_at").isNotNull(), kind))


def timer_rows(with_deadlines: DataFrame) -> DataFrame:
    """Two named timer rows (warning, breach) per run with a deadline; names are unique per run and kind."""
    timers = F.array(
        F.struct(F.lit("warning").alias("suffix"), F.lit("SLA_WARNING").alias("alert_type"),
                 F.col("warning_at").alias("fire_at"), F.col("breach_at").alias("breach_at")),
        F.struct(F.lit("breach").alias("suffix"), F.lit("SLA_BREACH").alias("alert_type"),
                 F.col("breach_at").alias("fire_at"), F.lit(None).cast("timestamp").alias("breach_at")))
    rows = with_deadlines.filter(F.col("deadline_error").isNull()).select(*RUN_KEY, F.explode(timers).alias("t"))
    return rows.select(*RUN_KEY, F.concat_ws("-", *RUN_KEY, F.lit("sla"), F.col("t.suffix")).alias("name"), "t.*")


def latest_job_events(job_log: DataFrame) -> DataFrame:
    extra = [c for c in ("event", "error", "duration", "run_id", "category") if c in job_log.columns]
    return latest_by(job_log, RUN_KEY, ["event_ms", "seq"], extra)


def terminal_runs(job_log: DataFrame) -> DataFrame:
    """Runs whose latest job event ends them."""
    return latest_job_events(job_log.select(*RUN_KEY, "event_ms", "seq", "event")).filter(
        F.col("event").isin(*TERMINAL_EVENTS)).select(*RUN_KEY, "event", "event_ms")


def finished_runs(triggers: DataFrame, job_log: DataFrame) -> DataFrame:
    """Runs finished by trigger status or by a terminal latest event."""
    by_status = triggers.filter(F.col("status").isin(*FINISHED)).select(*RUN_KEY)
    return by_status.union(terminal_runs(job_log).select(*RUN_KEY)).distinct()


def action_hint(status: Column, alert_type: Column) -> Column:
    return (
        F.when(status == "RUNNING", "pipeline running — may complete before breach")
        .when((status == "not started") & (alert_type == "SLA_BREACH"), "pipeline not started — investigate trigger")
        .otherwise("pipeline not started — check sensor data"))


def fire_alerts(timers: DataFrame, triggers: DataFrame, job_log: DataFrame, *, now: Column) -> DataFrame:
    """Timers to publish: finished runs and warnings at or past their breach are dropped; status and hint added."""
    late_warning = (F.col("alert_type") == "SLA_WARNING") & F.coalesce(now >= F.col("breach_at"), F.lit(False))
    open_rows = timers.filter(~late_warning).join(finished_runs(triggers, job_log), RUN_KEY, "left_anti")
    j = open_rows.join(triggers.select(*RUN_KEY, F.col("status").alias("_s")), RUN_KEY, "left")
    status = F.coalesce("_s", F.lit("not started"))
    return j.withColumns({"status": status, "action_hint": action_hint(status, F.col("alert_type")), "source": F.lit("schedule")}).drop("_s")


def final_verdicts(completions: DataFrame, triggers: DataFrame, *, at: Column, recompute: bool = False) -> DataFrame:
    """SLA_MET or SLA_BREACH at completion time ``at``; runs that were never triggered give no row.

    Uses the stored ``breach_at``; ``recompute`` derives it again in UTC with roll-forward from ``at``.
    """
    c = completions
    if recompute:
        c = absolute_deadline(c.drop("breach_at", "warning_at", "deadline_error").withColumn(
            "sla_timezone", F.lit("")), now=at)
    verdict = F.when(F.col("breach_at").isNotNull() & (at >= F.col("breach_at")), "SLA_BREACH").otherwise("SLA_MET")
    return c.withColumn("verdict", verdict).join(triggers.select(*RUN_KEY), RUN_KEY, "left_semi")


def plan_alerts(configs: DataFrame, triggers: DataFrame, job_log: DataFrame, *, now: Column) -> DataFrame:
    """Upcoming deadline per pipeline: skips observation-only, excluded and finished ones; keeps breach > now."""
    c = F.col("cfg")
    sla = c["sla"]
    hourly = F.coalesce(sla["deadline"].startswith(":"), F.lit(False))
    previous = Z.plus_seconds(now, -HOUR)
    date = F.when(hourly, F.date_format(previous, "yyyy-MM-dd'T'HH")).otherwise(Z.day_text(now))
    sensor_daily = ~Z.non_empty(c["schedule"]["cron"]) & ~hourly
    p = configs.filter(sla.isNotNull() & ~F.coalesce(c["dryRun"], F.lit(False)) & ~Z.excluded_at(c, now)).select(
        "pipeline_id", Z.schedule_id(c).alias("schedule_id"), date.alias("exec_date"),
        F.when(sensor_daily, Z.day_text(Z.plus_seconds(now, DAY))).otherwise(date).alias("sla_date"),
        sla["deadline"].alias("deadline"), sla["expectedDuration"].alias("expected_duration"),
        sla["timezone"].alias("sla_timezone"))
    p = p.join(finished_runs(triggers, job_log), RUN_KEY, "left_anti")
    return absolute_deadline(p, now=now, date="sla_date").filter(F.col("breach_at") > now)


def relative_breaches(configs: DataFrame, arrivals: DataFrame, triggers: DataFrame, job_log: DataFrame,
                      markers: DataFrame, *, now: Column) -> DataFrame:
    """Runs of today and yesterday past arrival + maximum, not finished, once per date.

    ``arrivals``: run key and ``arrival_at``; ``markers``: pipeline_id and exec_date already alerted.
    """
    c = F.col("cfg")
    limit = V.duration_seconds(c["sla"]["maxDuration"])
    days = F.array(Z.day_text(now), Z.day_text(Z.plus_seconds(now, -DAY)))
    p = configs.filter(~F.coalesce(c["dryRun"], F.lit(False)) & limit.isNotNull()).select(
        "pipeline_id", Z.schedule_id(c).alias("schedule_id"), limit.alias("max_s"), F.explode(days).alias("exec_date"))
    j = p.join(arrivals.select("pipeline_id", "exec_date", "arrival_at"), ["pipeline_id", "exec_date"])
    j = j.withColumn("breach_at", Z.plus_seconds(F.col("arrival_at"), F.col("max_s"))).filter(now >= F.col("breach_at"))
    return j.join(finished_runs(triggers, job_log), RUN_KEY, "left_anti").join(
        markers, ["pipeline_id", "exec_date"], "left_anti")


def project(runs: DataFrame, *, at: Column) -> DataFrame:
    """Start + expected duration against the deadline: ``sla_status`` met/breach, ``margin_s``; n/a without one.

    A deadline that cannot be computed leaves ``met`` without margin; an unparseable duration gives n/a.
    """
    expected = V.duration_seconds(F.col("expected_duration"))
    d = absolute_deadline(runs, now=at)
    est = Z.plus_seconds(at, expected)
    status = (
        F.when(expected.isNull(), "n/a")
        .when(V.non_null_text(F.col("deadline")) & (est > F.col("breach_at")), "breach")
        .otherwise("met"))
    margin = (F.unix_micros("breach_at") - F.unix_micros(est)) / F.lit(1e6)
    return d.withColumns({"estimated_at": est, "sla_status": status,
                          "margin_s": F.when(V.non_null_text(F.col("deadline")), margin)})


def first_arrivals(hits: DataFrame, triggers: DataFrame | None = None) -> DataFrame:
    """First qualifying sensor write per run (``arrival_ms``); runs that already exist record none."""
    first = earliest_by(hits, RUN_KEY, ["ts_ms", "seq"], [])
    if triggers is not None:
        first = first.join(triggers.select(*RUN_KEY), RUN_KEY, "left_anti")
    return first.select(*RUN_KEY, F.col("ts_ms").alias("arrival_ms"), "seq",
                        F.timestamp_millis(F.floor(F.col("ts_ms") / 1000) * 1000).alias("arrival_at"))
