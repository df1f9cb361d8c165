"""The post-run path live: sensor writes, run statuses, completions and reruns as one change stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from slipway.operators.drift import capture_baselines, match_post_rules
from slipway.operators.postrun import check_writes
from slipway.operators.rules import valid_configs
from slipway.schema import RUN_KEY
from slipway.session import staged
from slipway.streaming.jobs import RUN_DDL, StateTable, run_available
from slipway.streaming.state import KeyedState

CHANGE_DDL = (
    f"kind STRING, {RUN_DDL}, sensor_key STRING, data MAP<STRING, VARIANT>, ts TIMESTAMP, at_ms BIGINT, seq BIGINT, status STRING")
SENSOR_DDL = "pipeline_id STRING, sensor_key STRING, data MAP<STRING, VARIANT>, ts_ms BIGINT, seq BIGINT"
STATUS_DDL = f"{RUN_DDL}, at_ms BIGINT, seq BIGINT, status STRING"
BASELINE_DDL = f"{RUN_DDL}, rule_key STRING, captured_ms BIGINT, baseline MAP<STRING, VARIANT>"
RESET_DDL = f"{RUN_DDL}, at_ms BIGINT"
OUTCOME_DDL = (
    f"{RUN_DDL}, ts_ms BIGINT, seq BIGINT, rule_key STRING, previous_count DOUBLE, current_count DOUBLE,"
    " event_type STRING, follow_up STRING")


def post_run_changes(sensor_log: DataFrame, statuses: DataFrame, completions: DataFrame, resets: DataFrame) -> DataFrame:
    """One change stream: sensor writes, statuses (at_ms, seq, status), completions and resets (at_ms) of runs."""
    parts = {
        "sensor": sensor_log.select("pipeline_id", "sensor_key", "data", "ts", F.col("ts_ms").alias("at_ms"), "seq"),
        "status": statuses.select(*RUN_KEY, "at_ms", "seq", "status"),
        "completion": completions.select(*RUN_KEY, "at_ms"), "reset": resets.select(*RUN_KEY, "at_ms"),
    }
    out = sensor_log.sparkSession.createDataFrame([], CHANGE_DDL)
    for kind, rows in parts.items():
        out = out.unionByName(rows.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return out


def _split(changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    def of(kind: str) -> DataFrame:
        return changes.filter(F.col("kind") == kind)

    return (of("sensor").select("pipeline_id", "sensor_key", "data", "ts", F.col("at_ms").alias("ts_ms"), "seq"),
            of("status").select(*RUN_KEY, "at_ms", "seq", "status"),
            of("completion").select(*RUN_KEY, F.col("at_ms").alias("event_ms")).distinct(),
            of("reset").select(*RUN_KEY, "at_ms"))


def post_run_batch(changes: DataFrame, configs: DataFrame) -> DataFrame:
    """The outcomes of all changes at once, as a batch."""
    writes, statuses, completions, resets = _split(changes)
    captured = capture_baselines(completions, configs, writes).select(*RUN_KEY, "rule_key", "captured_ms", "baseline")
    return check_writes(match_post_rules(writes, valid_configs(configs)), statuses, captured, resets, writes, configs)


class PostRunStates:
    """The last version of each sensor, by pipeline; of each run's status, reset and baseline per rule key, by run."""

    def __init__(self, spark: SparkSession, path: str, **options):
        def state(name: str, ddl: str, key: list[str], by: list[str] = RUN_KEY) -> KeyedState:
            return KeyedState(spark, f"{path}/{name}", ddl, key, by=by, **options)

        self.sensors = state("sensors", SENSOR_DDL, ["pipeline_id", "sensor_key"], ["pipeline_id"])
        self.statuses = state("statuses", STATUS_DDL, RUN_KEY)
        self.resets = state("resets", RESET_DDL, RUN_KEY)
        self.baselines = state("baselines", BASELINE_DDL, [*RUN_KEY, "rule_key"])


def _newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = F.struct(*[c for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.max_by(rest, F.struct(*order)).alias("_r")).select(*key, "_r.*")


def post_run_stream(changes: DataFrame, read_configs: Callable[[], DataFrame], states: PostRunStates, outcomes: StateTable,
                    **options) -> None:
    """Outcomes of sensor writes as they come (``check_writes``), with states kept by run and pipeline.

    A completion captures its baselines from the sensors as they were at its moment; a micro-batch looks up only the runs and
    pipelines it names. Where changes come in order of time, micro-batch ends do not change the result; the
    outcomes then equal ``post_run_batch``. A rerun is a reset: it hides the baselines captured before it.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        # A micro-batch is read many times and cannot be pruned itself: kinds and columns of the stored copy can.
        writes, statuses, completions, resets = _split(staged(batch, "post-run-changes", ["kind"]))
        configs = read_configs()
        asked = writes.select("pipeline_id").unionByName(completions.select("pipeline_id"))
        known = states.sensors.lookup(asked, batch_id)
        history = staged(known.unionByName(writes.drop("ts")), "sensor-history")
        captured = staged(capture_baselines(completions, configs, history).select(
            *RUN_KEY, "rule_key", "captured_ms", "baseline"), "captured")
        matched = staged(match_post_rules(writes, valid_configs(configs)), "post-run-writes")
        out = check_writes(
            matched, states.statuses.lookup(matched, batch_id).unionByName(statuses),
            states.baselines.lookup(matched, batch_id).unionByName(captured),
            states.resets.lookup(matched, batch_id).unionByName(resets), history, configs)
        outcomes.write(out, batch_id)

        states.sensors.update(_newest(history, ["pipeline_id", "sensor_key"], ["ts_ms", "seq"]), batch_id)
        states.statuses.update(_newest(states.statuses.lookup(statuses, batch_id).unionByName(statuses), RUN_KEY, ["at_ms", "seq"]), batch_id)
        states.resets.update(states.resets.lookup(resets, batch_id).unionByName(resets).groupBy(*RUN_KEY).agg(
            F.max("at_ms").alias("at_ms")), batch_id)
        states.baselines.update(_newest(captured.unionByName(states.baselines.lookup(captured, batch_id)),
                                        [*RUN_KEY, "rule_key"], ["captured_ms"]), batch_id)

    run_available(changes, each, **options)
