"""Observation-only ("dry-run") pipelines: what would have happened, without starting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slipway.functions.ordered import earliest_by
from slipway.operators import drift as D, sla as L
from slipway.operators.runs import evaluate_ticks
from slipway.schema import RUN_KEY


def would_trigger(hits: DataFrame, configs: DataFrame, sensor_log: DataFrame, markers: DataFrame | None = None
                  ) -> DataFrame:
    """First trigger hit per run at which all rules hold on the history so far (``triggered_ms``, ``seq``)."""
    ticks = hits.select(*RUN_KEY, F.col("ts_ms").alias("tick_ms"), "seq")
    passed = evaluate_ticks(ticks, configs, sensor_log).filter("passed")
    first = earliest_by(passed, RUN_KEY, ["tick_ms", "seq"], ["n_rules"]).withColumnRenamed("tick_ms", "triggered_ms")
    if markers is not None:
        first = first.join(markers.select(*RUN_KEY), RUN_KEY, "left_anti")
    return first.withColumn("event_type", F.lit("DRY_RUN_WOULD_TRIGGER"))


def late_data(hits: DataFrame, markers: DataFrame) -> DataFrame:
    """Every trigger hit after the marker of its run, with how late it was."""
    m = markers.select(*RUN_KEY, "triggered_ms", F.col("seq").alias("_mseq"))
    j = hits.select(*RUN_KEY, "ts_ms", "seq").join(m, RUN_KEY).filter(
        F.struct("ts_ms", "seq") > F.struct("triggered_ms", "_mseq"))
    return j.drop("_mseq").withColumns({
        "late_ms": F.col("ts_ms") - F.col("triggered_ms"), "event_type": F.lit("DRY_RUN_LATE_DATA")})


def completed_summary(markers: DataFrame, configs: DataFrame) -> DataFrame:
    """Per marker: projected completion and SLA status (n/a without an SLA duration)."""
    s = F.col("cfg")["sla"]
    texts = configs.select(
        "pipeline_id", s["deadline"].alias("deadline"), s["expectedDuration"].alias("expected_duration"),
        s["timezone"].alias("sla_timezone"))
    p = L.project(markers.join(texts, "pipeline_id"), at=F.timestamp_millis("triggered_ms"))
    return p.select(*RUN_KEY, "triggered_ms", "sla_status", "estimated_at", "breach_at", "margin_s",
                    F.lit("DRY_RUN_COMPLETED").alias("event_type"))


def would_drift(sensor_log: DataFrame, markers: DataFrame, configs: DataFrame) -> DataFrame:
    """Drift of post-run sensors against the state captured at the marker."""
    base = D.capture_baselines(markers, configs, sensor_log, at_ms="triggered_ms")
    matched = D.match_post_rules(sensor_log, configs, observe=True)
    j = matched.join(base.select(*RUN_KEY, "rule_key", "captured_ms", "baseline"), [*RUN_KEY, "rule_key"]).filter(
        F.col("ts_ms") > F.col("captured_ms"))
    return D.drift_columns(j).filter("drifted").withColumn("event_type", F.lit("DRY_RUN_DRIFT"))
