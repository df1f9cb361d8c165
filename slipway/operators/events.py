"""Event rows from decisions, alert routing and text, threads, alarms and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from slipway.functions import values as V
from slipway.functions.ordered import earliest_by
from slipway.schema import RUN_KEY

EVENT_SOURCE = "slipway"
# Event types delivered as alerts.
ALERT_TYPES = [
    "SLA_WARNING", "SLA_BREACH", "SLA_MET", "JOB_FAILED", "VALIDATION_EXHAUSTED", "RETRY_EXHAUSTED", "INFRA_FAILURE",
    "SFN_TIMEOUT", "SCHEDULE_MISSED", "DATA_DRIFT", "JOB_POLL_EXHAUSTED", "POST_RUN_DRIFT", "POST_RUN_DRIFT_INFLIGHT",
    "POST_RUN_FAILED", "POST_RUN_SENSOR_MISSING", "RERUN_ACCEPTED", "RERUN_REJECTED", "JOB_COMPLETED",
    "LATE_DATA_ARRIVAL", "TRIGGER_RECOVERED", "BASELINE_CAPTURE_FAILED", "PIPELINE_EXCLUDED",
    "SENSOR_DEADLINE_EXPIRED", "IRREGULAR_SCHEDULE_MISSED", "RELATIVE_SLA_WARNING", "RELATIVE_SLA_BREACH",
    "DRY_RUN_WOULD_TRIGGER", "DRY_RUN_LATE_DATA", "DRY_RUN_SLA_PROJECTION", "DRY_RUN_DRIFT", "DRY_RUN_COMPLETED",
    "DRY_RUN_WOULD_RERUN", "DRY_RUN_RERUN_REJECTED", "DRY_RUN_WOULD_RETRY", "DRY_RUN_RETRY_EXHAUSTED",
]
# Event types shown as severe.
SEVERE_TYPES = [
    "SLA_BREACH", "JOB_FAILED", "VALIDATION_EXHAUSTED", "RETRY_EXHAUSTED", "INFRA_FAILURE", "SFN_TIMEOUT",
    "SCHEDULE_MISSED", "DATA_DRIFT", "JOB_POLL_EXHAUSTED",
]
MARKS = {"severe": "\U0001F534", "warning": "\U0001F7E1", "met": "✅", "info": "ℹ️"}


def build_events(decisions: DataFrame, *, ts_ms: Column, message: Column, event_type: str = "event_type",
                 detail: dict[str, Column] | None = None) -> DataFrame:
    """Envelope rows of every decision that has an event type; NULL details are left out of the map."""
    entries = [x for k, v in (detail or {}).items() for x in (F.lit(k), v.cast("string"))]
    m = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return decisions.filter(F.col(event_type).isNotNull()).select(
        F.lit(EVENT_SOURCE).alias("source"), F.col(event_type).alias("event_type"), *RUN_KEY,
        ts_ms.cast("bigint").alias("ts_ms"), message.alias("message"),
        F.map_filter(m, lambda _, v: v.isNotNull()).alias("detail"))


def union_events(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alerts(events: DataFrame) -> DataFrame:
    """Alert-worthy events; every event goes to the log regardless."""
    return events.filter(F.col("event_type").isin(*ALERT_TYPES))


def severity(event_type: Column) -> Column:
    return F.when(event_type.isin(*SEVERE_TYPES), "severe").when(event_type == "SLA_WARNING", "warning").when(
        event_type == "SLA_MET", "met").otherwise("info")


def alert_text(events: DataFrame) -> DataFrame:
    """Add ``severity`` and ``text``: header line, then detail parts and a hint, or the message without details."""
    t, d = F.col("event_type"), F.col("detail")
    sev = severity(t)
    mark = F.lit(MARKS["info"])
    for k in ("severe", "warning", "met"):
        mark = F.when(sev == k, F.lit(MARKS[k])).otherwise(mark)
    header = F.concat(mark, F.lit(" *"), t, F.lit("* | "), F.col("pipeline_id"), F.lit(" | "), F.col("exec_date"))

    def part(label: str, name: str) -> Column:
        return F.concat(F.lit(label), V.field(d, F.lit(name)))

    breach = V.field(d, F.lit("breachAt"))
    deadline = F.concat(part("Deadline ", "deadline"), F.when(
        breach.isNotNull(), F.concat(F.lit(" ("), breach, F.lit(")"))).otherwise(""))
    parts = F.concat_ws(" · ", deadline, part("Status: ", "status"), part("Source: ", "source"), part("Cron: ", "cron"))
    hint = F.concat(F.lit("\n→ "), V.field(d, F.lit("actionHint")))
    rich = F.concat(header, F.when(parts != "", F.concat(F.lit("\n"), parts)).otherwise(""), F.coalesce(hint, F.lit("")))
    plain = F.concat(header, F.lit("\n"), F.coalesce("message", F.lit("")))
    empty = F.coalesce(F.size(d), F.lit(0)) <= 0
    return events.withColumns({"severity": sev, "text": F.when(empty, plain).otherwise(rich)})


def threads(alert_rows: DataFrame, *, order: list[str]) -> DataFrame:
    """Add ``thread_id`` (``ts_ms``-first alert of the run) and ``opens_thread``."""
    first = earliest_by(alert_rows, RUN_KEY, order, []).select(*RUN_KEY, F.col(order[-1]).alias("thread_id"))
    return alert_rows.join(first, RUN_KEY).withColumn("opens_thread", F.col(order[-1]) == F.col("thread_id"))


def alarm_periods(metrics: DataFrame, *, width: str = "5 minutes") -> DataFrame:
    """Tumbling periods of (name, stat, ts, value) compared with ``threshold``; ``stat`` is sum or max."""
    w = F.window("ts", width)
    agg = metrics.groupBy(w.alias("w"), "name", "stat", "threshold").agg(
        F.sum("value").alias("_sum"), F.max("value").alias("_max"))
    value = F.when(F.col("stat") == "max", F.col("_max")).otherwise(F.col("_sum"))
    return agg.select("name", "stat", "threshold", F.col("w.start").alias("period_start"), value.alias("value"),
                      (value >= F.col("threshold")).alias("alarm"))


def merge_periods(parts: DataFrame) -> DataFrame:
    """Whole alarm periods from partial ones (name, stat, threshold, period_start, value)."""
    whole = parts.groupBy("name", "stat", "threshold", "period_start").agg(
        F.sum("value").alias("_sum"), F.max("value").alias("_max"))
    value = F.when(F.col("stat") == "max", F.col("_max")).otherwise(F.col("_sum"))
    return whole.select("name", "stat", "threshold", "period_start", value.alias("value"),
                        (value >= F.col("threshold")).alias("alarm"))


def alarm_transitions(periods: DataFrame) -> DataFrame:
    """State changes of each alarm in period order, from OK; periods without data are not breaching.

    The window runs over period summaries, not over metric rows.
    """
    w = W.partitionBy("name").orderBy("period_start")
    gap = F.unix_seconds("period_start") - F.unix_seconds(F.lag("period_start").over(w)) > 300
    before = F.coalesce(F.lag("alarm").over(w) & ~gap, F.lit(False))
    p = periods.withColumn("_before", before)
    return p.filter(F.col("alarm") != F.col("_before")).select(
        "name", "period_start", "value", F.when(F.col("alarm"), "ALARM").otherwise("OK").alias("state"))


def alarm_events(transitions: DataFrame, *, only_alarms: bool = False) -> DataFrame:
    """INFRA_ALARM events of alarm state changes: all for the log, ALARM ones for alerts."""
    t = transitions.filter(F.col("state") == "ALARM") if only_alarms else transitions
    reason = F.concat(F.lit("value "), F.col("value").cast("string"))
    return t.select(
        F.lit("INFRA_ALARM").alias("event_type"), F.lit("INFRASTRUCTURE").alias("pipeline_id"),
        F.unix_millis("period_start").alias("ts_ms"),
        F.concat("name", F.lit(": "), "state", F.lit(" — "), reason).alias("message"))


def metrics(decisions: DataFrame, *, by: list[str], duration: str = "duration") -> DataFrame:
    """Counts and stage durations of a decision table (approximate percentiles merge across partitions)."""
    p = F.percentile_approx(duration, [0.5, 0.95])
    return decisions.groupBy(*by).agg(
        F.count("*").alias("n_records"), F.count_if(F.col("outcome") == "dead_letter").alias("n_dead"),
        F.sum(duration).alias("duration_sum"), F.max(duration).alias("duration_max"),
        p[0].alias("duration_p50"), p[1].alias("duration_p95"))
