"""Live forms of the decisions on Structured Streaming.

Stateless work (routing, conditions, calendars) is plain streaming DataFrame code. Decisions that must agree with
tables other jobs write run the batch operators inside ``foreachBatch`` against versioned state tables in the
shared folder; each micro-batch owns one sub-folder and overwrites it when replayed, so results are exactly-once.
Aggregates keep one partial row per key and micro-batch, so no row can come too late and no state outlives its batch.
Decisions about a run (locks, reruns, retries, polls) look up that run's rows in a ``KeyedState``, so a micro-batch
reads no more when the history grows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from slipway.operators import events as E, locks as K, reruns as N, rules as R, runs as J, watchdog as W
from slipway.schema import LOCK_SECONDS, RUN_KEY
from slipway.session import work_dir
from slipway.streaming.state import KeyedState

RUN_DDL = "pipeline_id STRING, schedule_id STRING, exec_date STRING"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, *, name: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """Parquet change stream of a folder; ``name`` picks one table of a folder that holds several."""
    r = spark.readStream.schema(schema)
    if name:
        r = r.option("pathGlobFilter", name)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def run_available(df: DataFrame, each: Callable[[DataFrame, int], None], *, mode: str = "append",
                  checkpoint: str | None = None) -> None:
    """Process everything available through ``foreachBatch``, however long it takes, then stop."""
    spark = df.sparkSession
    q = (
        df.writeStream.outputMode(mode).trigger(availableNow=True).foreachBatch(each)
        .option("checkpointLocation", checkpoint or work_dir(spark, "checkpoint")).start())
    try:
        q.awaitTermination()
    finally:
        q.stop()


class StateTable:
    """Append-only table of one sub-folder per micro-batch."""

    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.path, self.ddl = path, ddl
        spark.createDataFrame([], ddl).write.mode("overwrite").parquet(f"{path}/batch_id=-1")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All rows, or those of batches before one (partition pruning keeps a replay from seeing itself)."""
        df = spark.read.schema(f"{self.ddl}, batch_id BIGINT").parquet(self.path)
        df = df if before is None else df.filter(F.col("batch_id") < before)
        return df.drop("batch_id")

    def write(self, df: DataFrame, batch_id: int) -> DataFrame:
        """Write one micro-batch's rows; returns them as written."""
        df.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        return df.sparkSession.read.schema(self.ddl).parquet(f"{self.path}/batch_id={batch_id}")


def live_hits(sensors: DataFrame, configs: DataFrame) -> DataFrame:
    """Trigger hits of valid configs with ``excluded``, schedule id and execution date (batch or stream)."""
    return R.excluded_hits(R.trigger_hits(sensors, R.valid_configs(configs)))


LOCK_DDL = f"{RUN_DDL}, ttl_epoch BIGINT"
START_DDL = f"{RUN_DDL}, ts_ms BIGINT, seq BIGINT"


def lock_state(spark: SparkSession, path: str, **options) -> KeyedState:
    """The last lock of each run: the second at which it ends (null: never)."""
    return KeyedState(spark, path, LOCK_DDL, RUN_KEY, **options)


def _take_locks(hits: DataFrame, held: DataFrame, locks: KeyedState, starts: StateTable, batch_id: int) -> DataFrame:
    """The hits that take their run's lock, written to ``starts``; ``held`` are further locks beside the state's own."""
    own = locks.lookup(hits, batch_id)
    taken = K.lock_acquisitions(hits, own.unionByName(held.select(*RUN_KEY, "ttl_epoch")))
    new = starts.write(taken.select(*RUN_KEY, "ts_ms", "seq"), batch_id)
    locks.update(new.groupBy(*RUN_KEY).agg((F.max(F.expr("ts_ms div 1000")) + LOCK_SECONDS).alias("ttl_epoch")), batch_id)
    return new


def trigger_stream(sensors: DataFrame, read_configs: Callable[[], DataFrame], read_triggers: Callable[[], DataFrame],
                   locks: KeyedState, starts: StateTable, events: StateTable, **options) -> None:
    """Sensor writes to run starts: condition, calendar, execution date, and the lock of the run.

    A hit starts its run if no lock of the run is alive: neither one that an earlier hit took here nor a row of
    ``triggers`` (whose null ttl never ends). Excluded hits and started runs become event rows. Configs and triggers
    are read again in every micro-batch.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        hits = live_hits(batch, read_configs()).filter(~F.coalesce("cfg.dryRun", F.lit(False)))
        hits = hits.select(*RUN_KEY, "ts_ms", "seq", "excluded")
        new = _take_locks(hits.filter(~F.col("excluded")), read_triggers(), locks, starts, batch_id)
        excluded = hits.filter("excluded").select(*RUN_KEY, "ts_ms", "seq", F.lit("PIPELINE_EXCLUDED").alias("event_type"))
        events.write(new.withColumn("event_type", F.lit("JOB_TRIGGERED")).unionByName(excluded), batch_id)

    run_available(sensors, each, **options)


def lock_stream(hits: DataFrame, locks: KeyedState, starts: StateTable, **options) -> None:
    """Run starts: the hits that take their run's lock, which lasts ``LOCK_SECONDS``. Micro-batch ends change nothing."""
    def each(batch: DataFrame, batch_id: int) -> None:
        none = batch.sparkSession.createDataFrame([], LOCK_DDL)
        _take_locks(batch, none, locks, starts, batch_id)

    run_available(hits, each, **options)


def arrival_stream(hits: DataFrame, arrivals: StateTable, **options) -> None:
    """First sensor arrival per run and micro-batch; ``first_arrivals`` has the first of all."""
    def each(batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy(*RUN_KEY).agg(F.min(F.struct("ts_ms", "seq")).alias("f"))
        arrivals.write(first.select(*RUN_KEY, "f.*"), batch_id)

    run_available(hits, each, **options)


def first_arrivals(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy(*RUN_KEY).agg(F.min(F.struct("ts_ms", "seq")).alias("f")).select(*RUN_KEY, "f.*")


def late_data_stream(sensors: DataFrame, read_configs: Callable[[], DataFrame], read_triggers: Callable[[], DataFrame],
                     read_job_log: Callable[[], DataFrame], late: StateTable, **options) -> None:
    """Late data after completion; a run is reported once over all micro-batches."""
    def each(batch: DataFrame, batch_id: int) -> None:
        hits = R.live_only(live_hits(batch, read_configs()))
        found = N.late_data(hits, read_triggers(), read_job_log()).select(*RUN_KEY, "ts_ms", "seq", "late_ms")
        seen = late.read(batch.sparkSession, batch_id)
        late.write(found.join(seen.select(*RUN_KEY), RUN_KEY, "left_anti"), batch_id)

    run_available(sensors, each, **options)


DECISION_DDL = (
    f"{RUN_DDL}, requested_ms BIGINT, seq BIGINT, reason STRING, budget BIGINT, decision STRING, reject_reason STRING,"
    " event_type STRING, attempt BIGINT")


JOB_EVENT_DDL = f"{RUN_DDL}, event_ms BIGINT, seq BIGINT, event STRING"
RERUN_DDL = f"{RUN_DDL}, triggered_ms BIGINT, seq BIGINT, reason STRING"
SUMMARY_DDL = "pipeline_id STRING, n_sensors BIGINT, n_updated BIGINT, max_updated_ms BIGINT"
RUN_ROW_DDL = f"{RUN_DDL}, status STRING, ttl_epoch BIGINT"
USED_DDL = f"{RUN_DDL}, prior BIGINT"


class RunStates:
    """What decisions about a run look up: its job events, reruns and trigger row, and its pipeline's sensor updates."""

    def __init__(self, spark: SparkSession, path: str, job_log: DataFrame, reruns: DataFrame, triggers: DataFrame,
                 sensors: DataFrame | None = None, **options):
        def state(name: str, ddl: str, key: list[str], rows: DataFrame | None, **more) -> KeyedState:
            made = KeyedState(spark, f"{path}/{name}", ddl, key, **options, **more)
            return made if rows is None else made.seed(rows)

        self.events = state("events", JOB_EVENT_DDL, [*RUN_KEY, "event_ms", "seq"], job_log)
        self.reruns = state("reruns", RERUN_DDL, [*RUN_KEY, "triggered_ms", "seq"], reruns)
        self.used = state("used", USED_DDL, RUN_KEY, N.retries_used(reruns))
        self.triggers = state("triggers", RUN_ROW_DDL, RUN_KEY, triggers)
        summary = None if sensors is None else N.sensor_update_summary(sensors)
        self.sensors = state("sensors", SUMMARY_DDL, ["pipeline_id"], summary, by=["pipeline_id"])


def rerun_stream(requests: DataFrame, read_configs: Callable[[], DataFrame], runs: RunStates, decisions: StateTable,
                 **options) -> None:
    """Rerun decisions per micro-batch; earlier decisions count as reruns and as job events of their run."""
    def each(batch: DataFrame, batch_id: int) -> None:
        out = decisions.write(N.decide_reruns(
            batch, read_configs(), runs.reruns.lookup(batch, batch_id), runs.events.lookup(batch, batch_id),
            runs.triggers.lookup(batch, batch_id), runs.sensors.lookup(batch, batch_id)), batch_id)
        runs.reruns.update(out.filter("decision = 'accepted'").select(
            *RUN_KEY, F.col("requested_ms").alias("triggered_ms"), "seq", "reason"), batch_id)
        runs.events.update(out.filter("decision <> 'infra_failure'").select(
            *RUN_KEY, F.col("requested_ms").alias("event_ms"), "seq",
            F.when(F.col("decision") == "accepted", "rerun-accepted").otherwise("rerun-rejected").alias("event")), batch_id)
        for state in (runs.triggers, runs.sensors, runs.used):
            state.carry(batch.sparkSession, batch_id)

    run_available(requests, each, **options)


RETRY_DDL = (
    f"{RUN_DDL}, event_ms BIGINT, seq BIGINT, event STRING, category STRING, rerun_count BIGINT, max_retries BIGINT,"
    " decision STRING, event_type STRING, new_status STRING")
ROUTE_DDL = f"{RUN_DDL}, event_ms BIGINT, seq BIGINT, event STRING, route STRING, event_type STRING"


def job_stream(job_log: DataFrame, read_configs: Callable[[], DataFrame], runs: RunStates, routes: StateTable,
               retries: StateTable, **options) -> None:
    """New job events: each one's route, and the retry decision of each failure.

    A run's retries so far, and whether it has a trigger row, are looked up by run. Retries are counted and reset the
    lock; exhausted and excluded failures end the run.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        routed = N.route_job_events(batch)
        routes.write(routed.select(*RUN_KEY, "event_ms", "seq", "event", "route", "event_type"), batch_id)
        failed = batch.filter(F.col("event").isin("fail", "timeout"))
        before = runs.used.lookup(failed, batch_id)
        out = retries.write(N.decide_retries(
            failed, read_configs(), before, runs.triggers.lookup(failed, batch_id)), batch_id)
        again = F.col("decision").isin("retry", "retry_without_lock")
        used = out.filter(again).groupBy(*RUN_KEY).agg(F.count("*").alias("n")).join(before, RUN_KEY, "left")
        runs.used.update(used.select(*RUN_KEY, (F.col("n") + F.coalesce("prior", F.lit(0))).alias("prior")), batch_id)
        runs.reruns.update(out.filter(again).select(
            *RUN_KEY, F.col("event_ms").alias("triggered_ms"), "seq", F.lit(N.RETRY_REASON).alias("reason")), batch_id)
        last = out.filter("decision <> 'retry_without_lock'").groupBy(*RUN_KEY).agg(
            F.max(F.struct("event_ms", "seq", "new_status")).alias("x"))
        final = F.col("x.new_status")
        runs.triggers.update(last.select(
            *RUN_KEY, F.coalesce(final, F.lit("RUNNING")).alias("status"),
            F.when(final.isNull(), F.expr("x.event_ms div 1000") + LOCK_SECONDS).alias("ttl_epoch")), batch_id)
        runs.events.update(batch.select(*RUN_KEY, "event_ms", "seq", "event"), batch_id)
        runs.sensors.carry(batch.sparkSession, batch_id)

    run_available(job_log, each, **options)


FINDING_DDL = f"check STRING, {RUN_DDL}, event_type STRING"
ONCE_PER_DATE = ["missed_inclusion", "post_run_missing", "relative_breach"]


def watchdog_stream(ticks: DataFrame, checks_at: Callable[[Column, DataFrame, DataFrame], dict[str, DataFrame]],
                    read_triggers: Callable[[], DataFrame], findings: StateTable, **options) -> None:
    """Run the absence checks once per micro-batch of ``ticks``, whose latest ``ts`` is the clock.

    ``checks_at(now, triggers, markers)`` builds the checks. Earlier findings are the markers of once-per-date checks
    and of planned alerts, and the changes they made to runs are applied to ``triggers`` first, so a run is reported
    stale, recovered or expired once. A micro-batch without ticks finds nothing.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        at = batch.agg(F.max("ts")).first()[0]
        if at is None:
            return
        earlier = findings.read(batch.sparkSession, batch_id)
        markers = earlier.filter(F.col("check").isin(*ONCE_PER_DATE)).select("check", "pipeline_id", "exec_date")
        found = W.union_findings(checks_at(F.lit(at).cast("timestamp"), W.apply_findings(read_triggers(), earlier), markers))
        planned = earlier.filter("check = 'sla_plan'").select("check", *RUN_KEY)
        findings.write(found.join(planned, ["check", *RUN_KEY], "left_anti"), batch_id)

    run_available(ticks, each, **options)


HOUR_DDL = "pipeline_id STRING, exec_date STRING, n_rows BIGINT, last_ms BIGINT"


def hourly_stream(sensors: DataFrame, hours: StateTable, **options) -> None:
    """Each (pipeline, hour) is its own run: row counts per micro-batch, which ``hourly_runs`` adds up.

    Open hours are there as soon as they have rows, and a late row counts whenever it comes.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        hours.write(batch.groupBy("pipeline_id", F.date_format("ts", "yyyy-MM-dd'T'HH").alias("exec_date")).agg(
            F.count("*").alias("n_rows"), F.max("ts_ms").alias("last_ms")), batch_id)

    run_available(sensors, each, **options)


def hourly_runs(hours: DataFrame) -> DataFrame:
    return hours.groupBy("pipeline_id", "exec_date").agg(
        F.sum("n_rows").alias("n_rows"), F.max("last_ms").alias("last_ms"))


def hits_with_fresh_configs(sensors: DataFrame, read_configs: Callable[[], DataFrame], out: StateTable, **options) -> None:
    """Trigger hits with the configs of the moment: the static side is read again in every micro-batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        hits = live_hits(batch, read_configs())
        out.write(hits.select(*RUN_KEY, "ts_ms", "seq"), batch_id)

    run_available(sensors, each, **options)


PERIOD_DDL = "name STRING, stat STRING, threshold DOUBLE, period_start TIMESTAMP, value DOUBLE"


def alarm_stream(metrics: DataFrame, periods: StateTable, **options) -> None:
    """Five-minute alarm periods per micro-batch; ``E.merge_periods`` puts the parts of a period together."""
    def each(batch: DataFrame, batch_id: int) -> None:
        part = E.alarm_periods(batch).select(
            "name", "stat", F.col("threshold").cast("double").alias("threshold"), "period_start",
            F.col("value").cast("double").alias("value"))
        periods.write(part, batch_id)

    run_available(metrics, each, **options)


POLL_DDL = f"{JOB_EVENT_DDL}, passed_ms BIGINT"


def poll_changes(job_log: DataFrame, starts: DataFrame) -> DataFrame:
    """Job events and run starts as one change stream; starts have ``passed_ms``, events ``event_ms``."""
    return job_log.select(*RUN_KEY, "event_ms", "seq", "event").unionByName(
        starts.select(*RUN_KEY, "passed_ms"), allowMissingColumns=True)


class PollStates:
    """Starts of runs, and job events that came before their run's start."""

    def __init__(self, spark: SparkSession, path: str, **options):
        self.starts = KeyedState(spark, f"{path}/starts", f"{RUN_DDL}, passed_ms BIGINT", RUN_KEY, **options)
        self.pending = KeyedState(spark, f"{path}/pending", JOB_EVENT_DDL, [*RUN_KEY, "event_ms", "seq"], **options)


def poll_stream(changes: DataFrame, read_configs: Callable[[], DataFrame], states: PollStates, seen: StateTable,
                **options) -> None:
    """What polling can see of each micro-batch's job events: the last event of every (run, polling slot).

    Either side may come first. An event whose run has no start yet waits in ``pending``; when the start comes, it is
    taken from there and counts like an event of that micro-batch. The poll outcomes of all events so far are
    ``poll_replay`` over ``seen``.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        new = batch.filter("passed_ms is not null").select(*RUN_KEY, "passed_ms")
        events = batch.filter("event_ms is not null").select(*RUN_KEY, "event_ms", "seq", "event")
        waiting = states.pending.lookup(new, batch_id)
        known = states.starts.lookup(events, batch_id).join(new.select(*RUN_KEY), RUN_KEY, "left_anti").unionByName(new)
        seen.write(J.visible_events(known, read_configs(), events.unionByName(waiting)), batch_id)
        states.pending.update(events.join(known.select(*RUN_KEY), RUN_KEY, "left_anti"), batch_id, gone=waiting)
        states.starts.update(new, batch_id)

    run_available(changes, each, **options)
