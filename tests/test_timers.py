"""Live alert timers against a sequential walk over the changes."""

import random

import pytest
from pyspark.sql import functions as F

from slipway.functions.ordered import HOUR_MS
from slipway.operators import sla as L
from slipway.schema import FINISHED, TERMINAL_EVENTS
from slipway.session import work_dir
from slipway.streaming import jobs as T, timers as C
from slipway.streaming.state import KeyedState

ORDER = {"cancel": 0, "plan": 1, "event": 1, "status": 1, "tick": 2}
MINUTE = 60_000


def walk(changes):
    """Each change in order of time; of equal times cancels first, ticks last."""
    live, done, event, status, out = {}, set(), {}, {}, []
    for kind, run, at, seq, name, alert, fire, breach, value in sorted(changes, key=lambda c: (c[2], ORDER[c[0]], c[3] or 0)):
        if kind == "plan" and (run, name) not in done:
            live.setdefault((run, name), (max(at, fire), alert, fire, breach))
        elif kind == "cancel":
            live = {k: v for k, v in live.items() if k[0] != run}
        elif kind == "event":
            event[run] = value
        elif kind == "status":
            status[run] = value
        elif kind == "tick":
            for k in [k for k, v in live.items() if v[0] <= at]:
                _, alert, fire, breach = live.pop(k)
                done.add(k)
                ended = event.get(k[0]) in TERMINAL_EVENTS or status.get(k[0]) in FINISHED
                late = alert == "SLA_WARNING" and breach is not None and at >= breach
                out.append((k[0], k[1], fire, at, "finished" if ended else "late_warning" if late else "published",
                            status.get(k[0]) or "not started"))
    return sorted(out)


def some_changes(seed, n=240, hours=60):
    r, out = random.Random(seed), []
    for seq in range(n):
        at = r.randrange(hours * 60) * MINUTE
        run, kind = f"p{r.randrange(5)}", r.choices(["plan", "event", "status", "cancel"], [6, 3, 1, 1])[0]
        row = [kind, run, at, seq, None, None, None, None, None]
        if kind == "plan":
            fire = at + r.randrange(-120, 900) * MINUTE
            suffix = r.choice(["warning", "breach"])
            row[4:8] = [f"{run}-{r.randrange(8)}-{suffix}", f"SLA_{suffix.upper()}", fire,
                        fire + r.randrange(1, 90) * MINUTE if suffix == "warning" else None]
        elif kind == "event":
            row[8] = r.choice(["success", "fail", "rerun-accepted", "infra-trigger-retry"])
        elif kind == "status":
            row[8] = r.choice(["RUNNING", "COMPLETED", "FAILED_FINAL"])
        out.append(tuple(row))
    ticks = sorted({r.randrange(hours * 60) * MINUTE for _ in range(50)})
    return out + [("tick", None, at, None, None, None, None, None, None) for at in ticks]


def frame(spark, changes):
    return spark.createDataFrame([(k, run, run and "s", run and "d", *rest) for k, run, *rest in changes], C.CHANGE_DDL)


def found(df):
    return sorted((r.pipeline_id, r.name, r.fire_ms, r.fired_ms, r.outcome, r.status) for r in df.collect())


def write_parts(spark, changes, parts):
    """One file per part; a part ends between two times, as a log's segments do."""
    path = work_dir(spark, "changes")
    times = sorted({c[2] for c in changes})
    cuts = [times[len(times) * i // parts] for i in range(parts)] + [times[-1] + 1]
    for lo, hi in zip(cuts, cuts[1:]):
        frame(spark, [c for c in changes if lo <= c[2] < hi]).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path, states):
    alerts = T.StateTable(spark, work_dir(spark, "alerts"), C.ALERT_DDL)
    C.timer_stream(T.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1), states, alerts)
    return alerts.read(spark)


@pytest.mark.parametrize("seed", range(4))
def test_timers_as_a_batch_equal_a_walk(spark, seed):
    changes = some_changes(seed)
    want = walk(changes)
    assert {w[4] for w in want} == {"published", "finished", "late_warning"}
    assert found(C.timer_alerts(frame(spark, changes))) == want


def test_timers_over_batches_equal_a_walk(spark):
    changes = some_changes(7)
    want = walk(changes)
    states = C.TimerStates(spark, work_dir(spark, "timers"), buckets=3, deltas=2)
    got = found(stream(spark, write_parts(spark, changes, 5), states))
    assert got == want and len({w[:2] for w in got}) == len(got)
    last = max(c[2] for c in changes if c[0] == "tick")
    assert states.calendar.read(spark).filter(F.col("ready_ms") <= last).count() == 0  # what is due has gone
    ahead = states.names.read(spark).filter("not done").select("slot", *C.NAME_KEY)
    assert sorted(map(str, ahead.collect())) == sorted(map(str, states.calendar.read(spark).select("slot", *C.NAME_KEY).collect()))


def test_a_tick_reads_due_hours_only(spark):
    ddl = "slot INT, name STRING"
    s = KeyedState(spark, work_dir(spark, "calendar"), ddl, ["slot", "name"], by=["slot"], slot="slot", deltas=2)
    s.update(spark.createDataFrame([(h, f"t{h}") for h in range(40)], ddl), 0)
    due = s.through(spark, 2, 1)
    assert sorted(r.name for r in due.collect()) == ["t0", "t1", "t2"]
    assert {f.split("bucket=")[1].split("/")[0] for f in due.inputFiles()} == {"0", "1", "2"}
    s.update(spark.createDataFrame([(2, "late")], ddl), 1, gone=due, done_below=2)
    assert sorted(r.name for r in s.through(spark, 3, 2).collect()) == ["late", "t3"]
    assert s.through(spark, 1, 2).count() == 0 and s.read(spark).count() == 38


def test_timers_without_rows(spark):
    none = frame(spark, [])
    assert C.timer_alerts(none).count() == 0
    plan = ("plan", "p", 0, 1, "p-warning", "SLA_WARNING", HOUR_MS, None, None)
    assert C.timer_alerts(frame(spark, [plan])).count() == 0  # no tick, nothing fires
    tick = ("tick", None, HOUR_MS, None, None, None, None, None, None)
    assert found(C.timer_alerts(frame(spark, [plan, tick, tick]))) == [("p", "p-warning", HOUR_MS, HOUR_MS, "published", "not started")]


def test_timer_rows_become_changes(spark):
    at = F.timestamp_millis(F.lit(5 * HOUR_MS))
    due = spark.range(1).select(F.lit("p").alias("pipeline_id"), F.lit("s").alias("schedule_id"), F.lit("d").alias("exec_date"),
                                at.alias("breach_at"), F.timestamp_millis(F.lit(4 * HOUR_MS)).alias("warning_at"),
                                F.lit(None).cast("string").alias("deadline_error"))
    plans = L.timer_rows(due).withColumn("at_ms", F.lit(0).cast("bigint"))
    key = "pipeline_id STRING, schedule_id STRING, exec_date STRING"
    changes = C.timer_changes(
        plans, spark.createDataFrame([], f"{key}, event_ms BIGINT, seq BIGINT, event STRING"),
        spark.createDataFrame([], f"{key}, at_ms BIGINT, seq BIGINT, status STRING"),
        spark.createDataFrame([], f"{key}, at_ms BIGINT"), spark.createDataFrame([(4 * HOUR_MS + 1,), (6 * HOUR_MS,)], "tick_ms BIGINT"))
    got = [(r.name, r.fired_ms, r.outcome) for r in C.timer_alerts(changes).orderBy("name").collect()]
    assert got == [("p-s-d-sla-breach", 6 * HOUR_MS, "published"), ("p-s-d-sla-warning", 4 * HOUR_MS + 1, "published")]
