"""Absence detection: what should have happened by ``now`` and did not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipway.functions import values as V, zones as Z
from slipway.functions.ordered import earliest_by, once
from slipway.operators import calendars as C, drift as D, sla as L
from slipway.operators.rules import evaluate
from slipway.schema import RUN_KEY
from slipway.sources.control import apply_transitions, has_trigger_for_date


def _live(configs: DataFrame, now: Column | None = None) -> DataFrame:
    c = F.col("cfg")
    live = configs.filter(~F.coalesce(c["dryRun"], F.lit(False)))
    if now is None:
        return live
    return once(live, {"_excluded": Z.excluded_at(c, now)}).filter(~F.col("_excluded")).drop("_excluded")


def stale_runs(triggers: DataFrame, configs: DataFrame, *, now: Column) -> DataFrame:
    """Running rows strictly past their ttl, observation-only pipelines left out; they become FAILED_FINAL."""
    stale = triggers.filter((F.col("status") == "RUNNING") & (F.col("ttl_epoch") > 0)
                            & (F.unix_seconds(now) > F.col("ttl_epoch")))
    dry = configs.filter(F.col("cfg.dryRun")).select("pipeline_id")
    return stale.join(dry, "pipeline_id", "left_anti").withColumns({
        "new_status": F.lit("FAILED_FINAL"), "event_type": F.lit("SFN_TIMEOUT")})


def _started(date: Column, time: Column, zone: Column, now: Column) -> Column:
    """FALSE while the local clock is before ``time`` on ``date``; unparseable or missing times do not hold back."""
    good = time.rlike(r"^(\d|[01]\d|2[0-3]):[0-5]\d$")
    hours, minutes = (F.split_part(time, F.lit(":"), F.lit(i)).try_cast("int") for i in (1, 2))
    at = F.when(good, Z.plus_seconds(Z.midnight(V.valid_date(date)), hours * 3600 + minutes * 60))
    return F.coalesce(Z.to_local(now, zone) >= at, F.lit(True))


def missed_schedules(configs: DataFrame, triggers: DataFrame, *, now: Column, deployed_at: Column | None = None,
                     markers: DataFrame | None = None) -> DataFrame:
    """Cron pipelines without a run today. Repeats every tick unless ``markers`` of alerted dates are given."""
    c = F.col("cfg")["schedule"]
    zone = Z.zone_or_utc(c["timezone"])
    p = once(_live(configs, now).filter(Z.non_empty(c["cron"])), {"_zone": zone})
    p = once(p, {"_on": _started(Z.day_text(now), c["time"], F.col("_zone"), now)}).filter("_on")
    if deployed_at is not None:
        p = once(p, {"_fire": C.last_cron_fire(c["cron"], F.col("_zone"), now)}).filter(
            F.coalesce(F.col("_fire") >= deployed_at, F.lit(True)))
    p = p.select("pipeline_id", Z.schedule_id(F.col("cfg")).alias("schedule_id"), Z.day_text(now).alias("exec_date"),
                 c["cron"].alias("cron"), c["time"].alias("expected_time"))
    out = has_trigger_for_date(p, triggers).filter(~F.col("found")).drop("found")
    if markers is not None:
        out = out.join(markers.select("pipeline_id", "exec_date"), ["pipeline_id", "exec_date"], "left_anti")
    return out.withColumn("event_type", F.lit("SCHEDULE_MISSED"))


def missed_inclusions(configs: DataFrame, triggers: DataFrame, markers: DataFrame, *, now: Column) -> DataFrame:
    """The last three past inclusion dates without a run, once per date."""
    c = F.col("cfg")["schedule"]
    zone = Z.zone_or_utc(c["timezone"])
    live = _live(configs, now)
    info = live.select("pipeline_id", Z.schedule_id(F.col("cfg")).alias("schedule_id"), c["time"].alias("_time"),
                       zone.alias("_zone"))
    p = C.past_inclusions(live, now=now).select("pipeline_id", "exec_date").distinct().join(info, "pipeline_id")
    today = Z.day_text(Z.to_local(now, F.col("_zone")))
    p = p.filter((F.col("exec_date") != today) | _started(F.col("exec_date"), F.col("_time"), F.col("_zone"), now))
    out = has_trigger_for_date(p.drop("_time", "_zone"), triggers).filter(~F.col("found")).drop("found")
    return out.join(markers.select("pipeline_id", "exec_date"), ["pipeline_id", "exec_date"], "left_anti").withColumn(
        "event_type", F.lit("IRREGULAR_SCHEDULE_MISSED"))


def recover_triggers(configs: DataFrame, sensors: DataFrame, triggers: DataFrame, job_log: DataFrame, *, now: Column
                     ) -> DataFrame:
    """Sensor-driven runs whose condition holds now but that never started; one per (pipeline, date)."""
    s = F.col("cfg")["schedule"]
    p = _live(configs, now).filter(s["trigger"].isNotNull() & ~Z.non_empty(s["cron"]))
    j = sensors.join(p, "pipeline_id").filter(
        F.col("sensor_key").startswith(F.coalesce(s["trigger"]["key"], F.lit(""))))
    hit = evaluate(j, rule=s["trigger"], now=now).filter("passed").select(
        "pipeline_id", Z.schedule_id(F.col("cfg")).alias("schedule_id"),
        Z.execution_date(F.col("data"), now).alias("exec_date"), "sensor_key")
    first = earliest_by(hit, RUN_KEY, ["sensor_key"], [])
    missing = has_trigger_for_date(first, triggers).filter(~F.col("found")).drop("found")
    return missing.join(L.terminal_runs(job_log).select(*RUN_KEY), RUN_KEY, "left_anti").withColumn(
        "event_type", F.lit("TRIGGER_RECOVERED"))


def expired_windows(configs: DataFrame, triggers: DataFrame, job_log: DataFrame, *, now: Column) -> DataFrame:
    """Sensor windows past their deadline without a run: rows to insert as FAILED_FINAL.

    ``:MM`` closes in the hour after the previous hour's run, ``HH:MM`` on the day of ``now``, in the schedule's
    zone, else the SLA's, else UTC.
    """
    c = F.col("cfg")
    dl = c["schedule"]["trigger"]["deadline"]
    hourly = F.coalesce(dl.startswith(":"), F.lit(False))
    previous = Z.plus_seconds(now, -3600)
    date = F.when(hourly, F.date_format(previous, "yyyy-MM-dd'T'HH")).otherwise(Z.day_text(now))
    tz = F.when(V.non_null_text(c["schedule"]["timezone"]), c["schedule"]["timezone"]).otherwise(c["sla"]["timezone"])
    number = r"^[+-]?\d+$"
    left, right = (F.split(dl, ":", 2)[i] for i in (0, 1))
    hours = F.when(hourly, F.hour(previous) + 1).when(left.rlike(number), left.try_cast("int"))
    minutes = F.when(right.rlike(number), right.try_cast("int"))
    day = F.when(hourly, F.date_trunc("day", previous)).otherwise(F.date_trunc("day", now))
    local = F.when(dl.contains(":"), Z.plus_seconds(day, hours * 3600 + minutes * 60))
    p = _live(configs, now).filter(V.non_null_text(dl)).select(
        "pipeline_id", Z.schedule_id(c).alias("schedule_id"), date.alias("exec_date"), dl.alias("trigger_deadline"),
        Z.to_utc(local, Z.zone_or_utc(tz)).alias("closed_at"))
    due = p.filter(F.col("closed_at") <= now)
    return due.join(triggers.select(*RUN_KEY), RUN_KEY, "left_anti").join(
        L.terminal_runs(job_log).select(*RUN_KEY), RUN_KEY, "left_anti").withColumns({
            "new_status": F.lit("FAILED_FINAL"), "event_type": F.lit("SENSOR_DEADLINE_EXPIRED")})


#: Run status that a finding leaves behind.
CHANGES = {"stale": "FAILED_FINAL", "recovered": "RUNNING", "window_expired": "FAILED_FINAL"}


def apply_findings(triggers: DataFrame, findings: DataFrame) -> DataFrame:
    """Trigger snapshot after findings (check, run key): stale and expired runs have failed, recovered ones run.

    A run that was recovered and later failed has failed. New rows have no ttl.
    """
    to = F.lit(None).cast("string")
    for check, status in CHANGES.items():
        to = F.when(F.col("check") == check, status).otherwise(to)
    moves = findings.withColumn("_to", to).filter(F.col("_to").isNotNull()).groupBy(*RUN_KEY).agg(
        F.min("_to").alias("status"))  # FAILED_FINAL sorts before RUNNING
    return apply_transitions(triggers, moves.select(*RUN_KEY, F.lit("set").alias("action"), "status",
                                                    F.lit(0).cast("bigint").alias("at")))


def all_findings(configs: DataFrame, sensors: DataFrame, triggers: DataFrame, job_log: DataFrame, baselines: DataFrame,
                 arrivals: DataFrame, markers: DataFrame, *, now: Column) -> dict[str, DataFrame]:
    """Every check as (check, run key, event_type). Later checks see the rows that earlier ones change or insert.

    ``markers``: check, pipeline_id, exec_date already alerted.
    """
    def seen(check: str) -> DataFrame:
        return markers.filter(F.col("check") == check).select("pipeline_id", "exec_date")

    def named(check: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(check).alias("check"), *RUN_KEY, "event_type")

    stale = named("stale", stale_runs(triggers, configs, now=now))
    after = apply_findings(triggers, stale)
    recovered = named("recovered", recover_triggers(configs, sensors, after, job_log, now=now))
    after = apply_findings(after, recovered)
    planned = L.plan_alerts(configs, after, job_log, now=now).withColumn("event_type", F.lit(None).cast("string"))
    expired = named("window_expired", expired_windows(configs, after, job_log, now=now))
    last = apply_findings(after, expired)
    breaches = L.relative_breaches(configs, arrivals, last, job_log, seen("relative_breach"), now=now)
    return {
        "stale": stale,
        "missed_schedule": named("missed_schedule", missed_schedules(configs, triggers, now=now)),
        "missed_inclusion": named("missed_inclusion", missed_inclusions(configs, triggers, seen("missed_inclusion"), now=now)),
        "recovered": recovered,
        "sla_plan": named("sla_plan", planned),
        "window_expired": expired,
        "post_run_missing": named("post_run_missing", D.missing_post_sensors(
            configs, last, job_log, sensors, baselines, seen("post_run_missing"), now=now)),
        "relative_breach": named("relative_breach", breaches.withColumn("event_type", F.lit("RELATIVE_SLA_BREACH"))),
    }


def union_findings(checks: dict[str, DataFrame]) -> DataFrame:
    out = None
    for df in checks.values():
        out = df if out is None else out.unionByName(df)
    return out


def check_status(results: DataFrame) -> DataFrame:
    """Rollup of (check, ok, error): one row with a status map, and WATCHDOG_DEGRADED when any check failed."""
    ok = F.bool_and("ok")
    return results.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("check", F.when(F.col("ok"), "ok").otherwise(
            F.coalesce("error", F.lit("failed"))))))).alias("checks"),
        ok.alias("healthy"), F.when(~ok, F.lit("WATCHDOG_DEGRADED")).alias("event_type"))


def run_checks(checks: dict[str, DataFrame], path: str) -> tuple[DataFrame, DataFrame]:
    """Write every check's findings to ``path`` independently; return (findings, status).

    A failing check is reported and does not stop the others. The loop runs over check names only.
    """
    outcomes = []
    spark = next(iter(checks.values())).sparkSession
    for name, df in checks.items():
        try:
            df.write.mode("append").parquet(path)
            outcomes.append((name, True, None))
        except Exception as error:  # noqa: BLE001 - any failure of one check is data here
            outcomes.append((name, False, type(error).__name__))
    status = check_status(spark.createDataFrame(outcomes, "check string, ok boolean, error string"))
    schema = "check string, pipeline_id string, schedule_id string, exec_date string, event_type string"
    return spark.read.schema(schema).parquet(path), status
