"""Live alert timers: a calendar of due hours, of which a tick reads the due ones only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slipway.functions.ordered import HOUR_MS
from slipway.operators.timers import ALWAYS, NAME_KEY, judge, settle
from slipway.schema import RUN_KEY
from slipway.streaming.jobs import RUN_DDL, StateTable, run_available
from slipway.streaming.state import KeyedState

CHANGE_DDL = (
    f"kind STRING, {RUN_DDL}, at_ms BIGINT, seq BIGINT, name STRING, alert_type STRING, fire_ms BIGINT, breach_ms BIGINT,"
    " value STRING")
TIMER_DDL = f"{RUN_DDL}, name STRING, alert_type STRING, fire_ms BIGINT, breach_ms BIGINT, ready_ms BIGINT, slot INT"
MOVE_DDL = f"{TIMER_DDL}, fired_ms BIGINT, state STRING"
ALERT_DDL = (
    f"{RUN_DDL}, name STRING, alert_type STRING, fire_ms BIGINT, breach_ms BIGINT, fired_ms BIGINT, outcome STRING,"
    " status STRING, action_hint STRING")
FACT = "STRUCT<ms: BIGINT, seq: BIGINT, value: STRING>"


def timer_changes(plans: DataFrame, events: DataFrame, statuses: DataFrame, cancels: DataFrame, ticks: DataFrame) -> DataFrame:
    """One change stream. ``plans`` are ``sla.timer_rows`` with ``at_ms``, the others as in ``operators.timers``."""
    parts = {
        "plan": plans.select(*NAME_KEY, "at_ms", "alert_type", F.unix_millis("fire_at").alias("fire_ms"),
                             F.unix_millis("breach_at").alias("breach_ms")),
        "event": events.select(*RUN_KEY, F.col("event_ms").alias("at_ms"), "seq", F.col("event").alias("value")),
        "status": statuses.select(*RUN_KEY, "at_ms", "seq", F.col("status").alias("value")),
        "cancel": cancels.select(*RUN_KEY, "at_ms"),
        "tick": ticks.select(F.col("tick_ms").alias("at_ms")),
    }
    out = plans.sparkSession.createDataFrame([], CHANGE_DDL)
    for kind, rows in parts.items():
        out = out.unionByName(rows.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return out


class TimerStates:
    """Live timers by due hour, all names by run, and the last event and status of each run."""

    def __init__(self, spark: SparkSession, path: str, **options):
        self.calendar = KeyedState(spark, f"{path}/calendar", TIMER_DDL, ["slot", *NAME_KEY], by=["slot"], slot="slot", **options)
        self.names = KeyedState(spark, f"{path}/names", f"{TIMER_DDL}, done BOOLEAN", NAME_KEY, **options)
        self.runs = KeyedState(spark, f"{path}/runs", f"{RUN_DDL}, event {FACT}, status {FACT}", RUN_KEY, **options)
        self.moves = StateTable(spark, f"{path}/moves", MOVE_DDL)


def slot(ms: Column) -> Column:
    return F.floor(ms / HOUR_MS).cast("int")


def timer_stream(changes: DataFrame, states: TimerStates, alerts: StateTable, **options) -> None:
    """Timers as they are planned, cancelled and come due; each firing is one row of ``alerts`` with its outcome.

    ``changes`` are ``timer_changes``; the clock is their ticks. A tick reads the hours of the calendar that are due, and
    plans, cancels, events and statuses look up their own runs, so a micro-batch reads no more when the history or
    the number of timers ahead grows. Where changes come in order of time, micro-batch ends do not change the
    result; a row that comes late counts from the micro-batch that brings it. Fired names are kept, so none fires twice.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        of = {kind: batch.filter(F.col("kind") == kind) for kind in ("plan", "event", "status", "cancel", "tick")}
        ticks = of["tick"].select(F.col("at_ms").alias("tick_ms")).distinct()
        cancels = of["cancel"].select(*RUN_KEY, "at_ms")
        clock = ticks.agg(F.max("tick_ms")).first()[0]
        due_slot = None if clock is None else clock // HOUR_MS

        known = states.names.lookup(of["plan"].select(*RUN_KEY).unionByName(cancels.select(*RUN_KEY)), batch_id)
        carried = known.filter("not done").drop("done")
        if clock is not None:
            due = states.calendar.through(spark, due_slot, batch_id).filter(F.col("ready_ms") <= clock)
            carried = carried.unionByName(due).dropDuplicates(NAME_KEY)
        ready = F.greatest("at_ms", "fire_ms")
        new = of["plan"].select(*NAME_KEY, "alert_type", "fire_ms", "breach_ms", ready.alias("ready_ms"),
                                slot(ready).alias("slot"), F.col("at_ms").alias("since_ms"))
        new = new.join(known.filter("done").select(*NAME_KEY), NAME_KEY, "left_anti")
        moved = states.moves.write(settle(carried.withColumn("since_ms", F.lit(ALWAYS)).unionByName(new), cancels, ticks).select(
            *states.calendar.columns, "fired_ms", "state"), batch_id)

        fired = moved.filter("state = 'fired'").drop("ready_ms", "slot", "state")
        events = of["event"].select(*RUN_KEY, F.col("at_ms").alias("event_ms"), "seq", F.col("value").alias("event"))
        statuses = of["status"].select(*RUN_KEY, "at_ms", "seq", F.col("value").alias("status"))
        judged = judge(fired, events, statuses, states.runs.lookup(fired, batch_id))
        alerts.write(judged.select(*NAME_KEY, "alert_type", "fire_ms", "breach_ms", "fired_ms", "outcome", "status",
                                   "action_hint"), batch_id)

        live = moved.filter("state = 'live'")
        left = carried.join(live.select("slot", *NAME_KEY), ["slot", *NAME_KEY], "left_anti")
        states.calendar.update(live, batch_id, gone=left, done_below=due_slot)
        states.names.update(moved.filter("state <> 'cancelled'").withColumn("done", F.col("state") == "fired"), batch_id,
                            gone=moved.filter("state = 'cancelled'"))
        fact = F.struct(F.col("at_ms").alias("ms"), "seq", "value")
        latest = batch.filter(F.col("kind").isin("event", "status")).groupBy(*RUN_KEY).agg(
            *[F.max(F.when(F.col("kind") == k, fact)).alias(f"_{k}") for k in ("event", "status")])
        before = states.runs.lookup(latest, batch_id)
        states.runs.update(latest.join(before, RUN_KEY, "left").select(
            *RUN_KEY, *[F.greatest(f"_{k}", k).alias(k) for k in ("event", "status")]), batch_id)

    run_available(changes, each, **options)


def timer_alerts(changes: DataFrame) -> DataFrame:
    """The same for all changes at once, as a batch."""
    of = {kind: changes.filter(F.col("kind") == kind) for kind in ("plan", "event", "status", "cancel", "tick")}
    plans = of["plan"].select(*NAME_KEY, "alert_type", "fire_ms", "breach_ms", F.greatest("at_ms", "fire_ms").alias("ready_ms"),
                              F.col("at_ms").alias("since_ms"))
    settled = settle(plans, of["cancel"], of["tick"].select(F.col("at_ms").alias("tick_ms")).distinct())
    return judge(settled.filter("state = 'fired'").drop("ready_ms", "state"),
                 of["event"].select(*RUN_KEY, F.col("at_ms").alias("event_ms"), "seq", F.col("value").alias("event")),
                 of["status"].select(*RUN_KEY, "at_ms", "seq", F.col("value").alias("status")))
