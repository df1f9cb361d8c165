"""Post-run checks as of each sensor write: run status, baseline version, drift, and the rules on the sensors of that moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slipway.functions import zones as Z
from slipway.functions.ordered import as_of
from slipway.operators.drift import drift_columns, drift_field
from slipway.operators.runs import evaluate_ticks
from slipway.schema import RUN_KEY
from slipway.session import staged


def check_writes(matched: DataFrame, statuses: DataFrame, baselines: DataFrame, resets: DataFrame, sensor_log: DataFrame,
                 configs: DataFrame) -> DataFrame:
    """Outcome of each sensor write that a post-run rule matches (``drift.match_post_rules``) and that has any.

    ``statuses``: run key, at_ms, seq, status; ``baselines``: run key, rule_key, captured_ms, baseline, one row per
    capture; ``resets``: run key, at_ms of reruns, which remove the baselines captured before. All are read as of
    the write: a status of its moment or earlier, a baseline captured strictly before it. While its run is RUNNING a
    drifted write is informational. When it is COMPLETED, a drifted one asks for a rerun, unless its date is excluded,
    and any other is judged by all post-run rules on the sensors as they were at that moment, this write included.
    Writes of runs without a status, or with any other one, give no row.
    """
    # Of the configs and the data only what is read below travels along.
    exclude = F.struct(F.col("cfg.schedule.exclude").alias("exclude"))
    field = drift_field(F.col("drift_field"))
    w = matched.select(*RUN_KEY, "ts_ms", "seq", "rule_key", "drift_field", "drift_threshold", F.struct(
        exclude.alias("schedule")).alias("cfg"), F.map_filter("data", lambda k, _: k == field).alias("data"))
    w = as_of(w, statuses, RUN_KEY, probe_ms="ts_ms", fact_ms="at_ms", fact_order=["seq"], payload=["status"], out="_s")
    w = w.withColumn("_status", F.col("_s.status")).filter(F.col("_status").isin("RUNNING", "COMPLETED")).drop("_s")
    w = w.withColumn("_before", F.col("ts_ms") - 1)
    w = as_of(w, resets, RUN_KEY, probe_ms="ts_ms", fact_ms="at_ms", fact_order=[], payload=["at_ms"], out="_reset")
    w = as_of(w, baselines, [*RUN_KEY, "rule_key"], probe_ms="_before", fact_ms="captured_ms", fact_order=[],
              payload=["captured_ms", "baseline"], out="_b")
    valid = F.col("_reset").isNull() | (F.col("_b.captured_ms") >= F.col("_reset.at_ms"))
    # The writes with their status and drift are read three times below: stored once, without sensor data.
    w = staged(drift_columns(w.withColumn("baseline", F.when(valid, F.col("_b.baseline")))).select(
        *RUN_KEY, "ts_ms", "seq", "rule_key", "previous_count", "current_count", "drifted", "_status", "cfg"), "checked-writes")
    completed = F.col("_status") == "COMPLETED"

    judged = w.filter(completed & ~F.col("drifted"))
    rules = configs.select("pipeline_id", F.struct(F.struct(
        F.lit("ALL").alias("trigger"), F.col("cfg.postRun.rules").alias("rules")).alias("validation")).alias("cfg"))
    moments = judged.select(*RUN_KEY, F.col("ts_ms").alias("tick_ms")).distinct()
    verdicts = evaluate_ticks(moments, rules, sensor_log).select(*RUN_KEY, F.col("tick_ms").alias("ts_ms"), "passed")
    keep = [*RUN_KEY, "ts_ms", "seq", "rule_key", "previous_count", "current_count"]
    by_rules = judged.join(verdicts, [*RUN_KEY, "ts_ms"]).select(*keep, F.when(
        F.col("passed"), "POST_RUN_PASSED").otherwise("POST_RUN_FAILED").alias("event_type"), F.lit(None).cast("string").alias("follow_up"))
    follow_up = F.when(completed, F.when(Z.excluded_date(F.col("cfg"), F.col("exec_date")), "PIPELINE_EXCLUDED").otherwise("data-drift"))
    drifted = w.filter("drifted").select(*keep, F.when(completed, "POST_RUN_DRIFT").otherwise(
        "POST_RUN_DRIFT_INFLIGHT").alias("event_type"), follow_up.alias("follow_up"))
    return by_rules.unionByName(drifted)
