"""Baselines, drift, post-run checks and missing post-run sensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipway.functions import values as V, zones as Z
from slipway.functions.ordered import HOUR_MS, as_of, once
from slipway.operators.clean import remap_periods
from slipway.operators.rules import evaluate
from slipway.operators.sla import latest_job_events
from slipway.schema import RUN_KEY

DEFAULT_FIELD = "sensor_count"
SENSOR_TIMEOUT_SECONDS = 2 * 3600


def capture_baselines(completions: DataFrame, configs: DataFrame, sensor_log: DataFrame, *, at_ms: str = "event_ms",
                      bucket_ms: int = HOUR_MS) -> DataFrame:
    """Sensor state per post-run rule key as of each completion; runs with no matching sensor give no row.

    The state is an as-of lookup of the three spellings a key can have for the run's date; the period-suffixed
    spelling wins.
    """
    keys = configs.select("pipeline_id", F.explode(F.array_distinct(
        F.transform("cfg.postRun.rules", lambda r: r["key"]))).alias("rule_key"))
    compact = F.replace("exec_date", F.lit("-"), F.lit(""))
    spellings = F.array(F.concat("rule_key", F.lit("#"), "exec_date"), F.concat("rule_key", F.lit("#"), compact),
                        F.col("rule_key"))
    asked = completions.select(*RUN_KEY, F.col(at_ms).alias("captured_ms")).join(keys, "pipeline_id").select(
        *RUN_KEY, "captured_ms", "rule_key", F.posexplode(spellings).alias("_p", "sensor_key"))
    known = sensor_log.select("pipeline_id", "sensor_key").distinct()
    asked = asked.join(known, ["pipeline_id", "sensor_key"], "left_semi")
    hit = as_of(asked, sensor_log, ["pipeline_id", "sensor_key"], probe_ms="captured_ms", fact_ms="ts_ms",
                fact_order=["seq"], payload=["ts_ms", "seq", "data"], out="s", bucket_ms=bucket_ms)
    best = hit.filter(F.col("s").isNotNull()).groupBy(*RUN_KEY, "captured_ms", "rule_key").agg(
        F.min_by("s", "_p").alias("s"))
    return best.select(*RUN_KEY, "captured_ms", "rule_key", F.col("s.ts_ms").alias("sensor_ms"),
                       F.col("s.seq").alias("sensor_seq"), F.col("s.data").alias("baseline"))


def drift_field(field: Column) -> Column:
    """The name of the value that drifts."""
    return F.coalesce(F.nullif(field, F.lit("")), F.lit(DEFAULT_FIELD))


def drift_columns(df: DataFrame, *, previous: str = "baseline", current: str = "data", field: str = "drift_field",
                  threshold: str = "drift_threshold") -> DataFrame:
    """Add previous and current values, ``delta`` and ``drifted`` (absolute change above the threshold)."""
    name = drift_field(F.col(field))
    out = once(df, {"previous_count": V.number(V.field(F.col(previous), name)),
                    "current_count": V.number(V.field(F.col(current), name))})
    out = out.withColumn("delta", F.col("current_count") - F.col("previous_count"))
    above = F.abs("delta") > F.coalesce(F.col(threshold), F.lit(0.0))
    return out.withColumn("drifted", F.coalesce(above & ~F.isnan("delta"), F.lit(False)))


def match_post_rules(sensor_log: DataFrame, configs: DataFrame, *, observe: bool = False) -> DataFrame:
    """Sensor rows matching a post-run rule by key prefix (first rule in list order), not the trigger key.

    Pipelines without a trigger condition never look at post-run rules. The list is searched inside the row.
    """
    c = F.col("cfg")
    cfg = configs.filter(c["postRun"].isNotNull() & c["schedule"]["trigger"].isNotNull()
                         & (F.coalesce(c["dryRun"], F.lit(False)) == observe))
    j = sensor_log.join(cfg, "pipeline_id").filter(
        ~F.col("sensor_key").startswith(F.coalesce(c["schedule"]["trigger"]["key"], F.lit(""))))
    first = F.get(F.filter(c["postRun"]["rules"], lambda r: F.col("sensor_key").startswith(r["key"])), F.lit(0))
    return once(j, {
        "rule_key": first["key"], "schedule_id": Z.schedule_id(c),
        "exec_date": Z.execution_date(F.col("data"), F.col("ts")),
        "drift_field": c["postRun"]["driftField"], "drift_threshold": c["postRun"]["driftThreshold"],
    }).filter(F.col("rule_key").isNotNull())


def route_post_run(matched: DataFrame, triggers: DataFrame) -> DataFrame:
    """Add ``route`` by run status: inflight, completed or ignore; sensor rows without a run are dropped."""
    s = F.col("status")
    return matched.join(triggers.select(*RUN_KEY, "status"), RUN_KEY).withColumn(
        "route", F.when(s == "RUNNING", "inflight").when(s == "COMPLETED", "completed").otherwise("ignore"))


def with_baseline(routed: DataFrame, baselines: DataFrame, how: str) -> DataFrame:
    """Drift of every sensor write against the baseline captured before it; ``left`` keeps writes without one."""
    b = baselines.select(*RUN_KEY, "rule_key", "captured_ms", "baseline")
    later = routed.join(b, [*RUN_KEY, "rule_key"], how).filter(
        F.col("captured_ms").isNull() | (F.col("ts_ms") > F.col("captured_ms")))
    return drift_columns(later)


def keep_baselines(baselines: DataFrame, accepted: DataFrame) -> DataFrame:
    """Baselines that stay: an accepted rerun (run key, ``last``) after the capture removes its run's baseline."""
    j = baselines.join(accepted.select(*RUN_KEY, "last"), RUN_KEY, "left")
    return j.filter(F.col("last").isNull() | (F.col("last") <= F.col("captured_ms"))).drop("last")


def inflight_drift(routed: DataFrame, baselines: DataFrame) -> DataFrame:
    """Informational drift of running runs that still have a baseline."""
    d = with_baseline(routed.filter(F.col("route") == "inflight"), baselines, "inner").filter("drifted")
    return d.withColumn("event_type", F.lit("POST_RUN_DRIFT_INFLIGHT"))


def completed_drift(routed: DataFrame, baselines: DataFrame) -> DataFrame:
    """Every sensor write after completion with its drift test; drifted ones carry event and follow-up.

    The follow-up is a rerun request, or PIPELINE_EXCLUDED when the execution date is excluded.
    """
    d = with_baseline(routed.filter(F.col("route") == "completed"), baselines, "left")
    excluded = Z.excluded_date(F.col("cfg"), F.col("exec_date"))
    return d.withColumns({
        "event_type": F.when(F.col("drifted"), F.lit("POST_RUN_DRIFT")),
        "follow_up": F.when(F.col("drifted"), F.when(excluded, "PIPELINE_EXCLUDED").otherwise("data-drift"))})


def post_run_results(checked: DataFrame, configs: DataFrame, sensors: DataFrame, *, now: Column) -> DataFrame:
    """POST_RUN_PASSED / POST_RUN_FAILED of completed, non-drifted sensor writes (all post-run rules must pass).

    The rules depend on the run only, so they are evaluated once per run and joined back to the writes.
    """
    rows = checked.filter(~F.col("drifted"))
    runs = rows.select(*RUN_KEY).distinct()
    rules = runs.join(configs.select("pipeline_id", F.col("cfg.postRun.rules").alias("_r")), "pipeline_id").select(
        *RUN_KEY, F.posexplode("_r").alias("pos", "rule"))
    wanted = rules.select("pipeline_id", "exec_date", F.col("rule.key").alias("key")).distinct()
    answers = remap_periods(wanted, sensors)
    matched = rules.withColumn("key", F.col("rule.key")).join(answers, ["pipeline_id", "exec_date", "key"], "left")
    verdicts = evaluate(matched, now=now).groupBy(*RUN_KEY).agg(F.bool_and("passed").alias("_ok"))
    return rows.join(verdicts, RUN_KEY).withColumn(
        "event_type", F.when(F.col("_ok"), "POST_RUN_PASSED").otherwise("POST_RUN_FAILED")).drop("_ok")


def missing_post_sensors(configs: DataFrame, triggers: DataFrame, job_log: DataFrame, sensors: DataFrame,
                         baselines: DataFrame, markers: DataFrame, *, now: Column, scale_seconds: bool = False
                         ) -> DataFrame:
    """Runs completed today whose post-run sensors have not changed within the timeout; once per date.

    Sensor times are compared as stored unless ``scale_seconds``; keys match exactly, without period remapping.
    """
    c = F.col("cfg")
    today = Z.day_text(now)
    timeout = F.coalesce(V.duration_seconds(F.coalesce(c["postRun"]["sensorTimeout"], F.lit(""))),
                         F.lit(float(SENSOR_TIMEOUT_SECONDS)))
    p = configs.filter((F.size(F.coalesce(c["postRun"]["rules"], F.array().cast("array<struct<key:string,check:string,field:string,value:variant>>"))) > 0)
                       & ~F.coalesce(c["dryRun"], F.lit(False))).select(
        "pipeline_id", Z.schedule_id(c).alias("schedule_id"), timeout.alias("timeout_s"),
        F.transform(c["postRun"]["rules"], lambda r: r["key"]).alias("rule_keys"), today.alias("exec_date"))
    done = triggers.filter((F.col("exec_date") == today) & (F.col("status") == "COMPLETED")).select(*RUN_KEY)
    success = latest_job_events(job_log.filter(F.col("exec_date") == today).select(
        *RUN_KEY, "event_ms", "seq", "event")).filter(F.col("event") == "success").select(
        *RUN_KEY, F.col("event_ms").alias("completed_ms"))
    due = p.join(done, RUN_KEY).join(success, RUN_KEY).filter(
        F.unix_millis(now) >= F.col("completed_ms") + F.round(F.col("timeout_s") * 1000))
    due = due.join(baselines.select("pipeline_id", "exec_date"), ["pipeline_id", "exec_date"], "left_semi").join(
        markers.select("pipeline_id", "exec_date"), ["pipeline_id", "exec_date"], "left_anti")
    updated = V.epoch_ms_value(V.field(F.col("data"), F.lit("updatedAt")), scale_seconds=scale_seconds)
    changed = sensors.select("pipeline_id", "sensor_key", updated.alias("_u"))
    answered = due.select(*RUN_KEY, "completed_ms", F.explode("rule_keys").alias("sensor_key")).join(
        changed, ["pipeline_id", "sensor_key"]).filter(F.col("_u") > F.col("completed_ms")).select(*RUN_KEY)
    return due.join(answered, RUN_KEY, "left_anti").withColumn("event_type", F.lit("POST_RUN_SENSOR_MISSING"))
