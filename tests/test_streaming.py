"""Micro-batched runs must agree with the batch operators on the same log."""

import random

import pytest
from pyspark.sql import functions as F

from slipway.operators.locks import lock_acquisitions
from slipway.operators import events as E, reruns as N, rules as R, runs as J, sla as L, watchdog as W
from slipway.plans.registry import Tables
from slipway.schema import LOCK_SECONDS, RUN_KEY
from slipway.session import prepare, work_dir
from slipway.streaming import jobs as T
from slipway.streaming.state import KeyedState
from tests_support import SF


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(prepare(spark), SF)


def in_order(df, path, ms, parts):
    """Write ``parts`` files whose names and times follow the order column."""
    cuts = df.approxQuantile(ms, [i / parts for i in range(parts + 1)], 0.0)
    for i in range(parts):
        lo, hi = cuts[i], cuts[i + 1]
        upper = F.col(ms) <= hi if i == parts - 1 else F.col(ms) < hi
        df.filter((F.col(ms) >= lo) & upper).coalesce(1).write.mode("append").parquet(path)


def rows(df):
    return sorted(map(str, df.collect()))


def run_states(spark, tables, job_log=None, **options):
    log = tables.job_log if job_log is None else job_log
    return T.RunStates(spark, work_dir(spark, "runs"), log, tables.reruns, tables.triggers, tables.sensors, **options)


def test_rerun_stream_in_three_batches_equals_batch(spark, tables):
    path = work_dir(spark, "requests")
    in_order(tables.rerun_requests, path, "requested_ms", 3)
    out = T.StateTable(spark, work_dir(spark, "decisions"), T.DECISION_DDL)
    stream = T.read_stream(spark, path, tables.rerun_requests.schema, files_per_batch=1)
    T.rerun_stream(stream, lambda: tables.configs, run_states(spark, tables), out)
    batch = N.rerun_decisions(tables.rerun_requests, tables.configs, tables.reruns, tables.job_log, tables.triggers,
                              tables.sensors)
    cols = [*RUN_KEY, "requested_ms", "seq", "decision", "reject_reason", "attempt"]
    assert rows(out.read(spark).select(*cols)) == rows(batch.select(*cols))


def test_late_data_is_reported_once_over_batches(spark, tables):
    path = work_dir(spark, "sensor-log")
    in_order(tables.sensor_log, path, "ts_ms", 3)
    out = T.StateTable(spark, work_dir(spark, "late"), f"{T.RUN_DDL}, ts_ms BIGINT, seq BIGINT, late_ms BIGINT")
    stream = T.read_stream(spark, path, tables.sensor_log.schema, files_per_batch=1)
    T.late_data_stream(stream, lambda: tables.configs, lambda: tables.triggers, lambda: tables.job_log, out)
    hits = R.live_only(T.live_hits(tables.sensor_log, tables.configs))
    batch = N.late_data(hits, tables.triggers, tables.job_log).select(*RUN_KEY, "ts_ms", "seq", "late_ms")
    assert rows(out.read(spark)) == rows(batch)


def test_config_change_takes_effect_in_the_next_batch(spark, tables):
    path = work_dir(spark, "sensor-log")
    in_order(tables.sensor_log, path, "ts_ms", 2)
    reads = []

    def configs():
        reads.append(1)
        return tables.configs if len(reads) == 1 else tables.configs.filter(F.lit(False))

    out = T.StateTable(spark, work_dir(spark, "hits"), f"{T.RUN_DDL}, ts_ms BIGINT, seq BIGINT")
    T.hits_with_fresh_configs(T.read_stream(spark, path, tables.sensor_log.schema, files_per_batch=1), configs, out)
    everything = T.live_hits(tables.sensor_log, tables.configs).count()
    assert len(reads) == 2 and 0 < out.read(spark).count() < everything


def test_replayed_batch_overwrites_itself(spark):
    s = T.StateTable(spark, work_dir(spark, "state"), "x BIGINT")
    s.write(spark.range(3).withColumnRenamed("id", "x"), 0)
    s.write(spark.range(2).withColumnRenamed("id", "x"), 0)
    s.write(spark.range(5).withColumnRenamed("id", "x"), 1)
    assert s.read(spark, 1).count() == 2 and s.read(spark).count() == 7


@pytest.fixture(scope="module")
def sensor_parts(spark, tables):
    path = work_dir(spark, "sensor-parts")
    in_order(tables.sensor_log, path, "ts_ms", 3)
    return lambda: T.read_stream(spark, path, tables.sensor_log.schema, files_per_batch=1)


def test_existing_runs_do_not_start_again(spark, tables, sensor_parts):
    hits = R.live_only(T.live_hits(tables.sensor_log, tables.configs))
    first = L.first_arrivals(hits).select(*RUN_KEY, F.col("arrival_ms").alias("ts_ms"), "seq")
    old = first.orderBy(*RUN_KEY).limit(5)
    triggers = old.select(*RUN_KEY, F.lit("COMPLETED").alias("status"), F.lit(None).cast("bigint").alias("ttl_epoch"))
    starts = T.StateTable(spark, work_dir(spark, "starts"), T.START_DDL)
    events = T.StateTable(spark, work_dir(spark, "events"), f"{T.START_DDL}, event_type STRING")
    T.trigger_stream(sensor_parts(), lambda: tables.configs, lambda: triggers,
                     T.lock_state(spark, work_dir(spark, "locks")), starts, events)
    assert rows(starts.read(spark)) == rows(lock_acquisitions(hits, triggers).select(*RUN_KEY, "ts_ms", "seq"))
    assert not starts.read(spark).join(old.select(*RUN_KEY), RUN_KEY, "left_semi").count()
    excluded = events.read(spark).filter("event_type = 'PIPELINE_EXCLUDED'").count()
    assert excluded == T.live_hits(tables.sensor_log, tables.configs).filter(
        F.col("excluded") & ~F.coalesce("cfg.dryRun", F.lit(False))).count()


def locked(hits, held=(), life=LOCK_SECONDS):
    """One pass over hits (run, ts_ms, seq) in time order."""
    until, out = {}, []
    for run, ttl in held:
        until[run] = max(until.get(run, 0), float("inf") if ttl is None else ttl)
    for run, ts, seq in sorted(hits, key=lambda h: (h[1], h[2])):
        if ts // 1000 >= until.get(run, 0):
            until[run] = ts // 1000 + life
            out.append((run, ts, seq, until[run]))
    return sorted(out)


def test_locks_end(spark):
    r = random.Random(2)
    hits = [("hot", r.randrange(3_000_000_000), k) for k in range(2500)] + [
        (r.choice("abcdef"), r.randrange(200_000_000), k) for k in range(400)] + [("z", 16_200_000, 1), ("z", 0, 2),
        ("z", 16_199_999, 3), ("z", 16_200_000, 0), ("y", 5_000, 1), ("x", 7_000, 1), ("w", 7_999, 1)]
    held = [("y", None), ("x", 8), ("w", 7), ("a", 90_000), ("a", 20_000)]
    df = spark.createDataFrame(hits, "pipeline_id string, ts_ms long, seq long").withColumns(
        {"schedule_id": F.lit("s"), "exec_date": F.lit("d")})
    locks = spark.createDataFrame(held, "pipeline_id string, ttl_epoch long").withColumns(
        {"schedule_id": F.lit("s"), "exec_date": F.lit("d")})
    got = lock_acquisitions(df, locks).select("pipeline_id", "ts_ms", "seq", "ttl_epoch").collect()
    assert sorted(map(tuple, got)) == locked(hits, held) and len(got) > 180


def test_locks_and_arrivals_over_batches(spark, tables, sensor_parts):
    starts, arrivals = (T.StateTable(spark, work_dir(spark, n), T.START_DDL) for n in ("starts", "arrivals"))

    def hits():
        return R.live_only(T.live_hits(sensor_parts(), tables.configs)).select(*RUN_KEY, "ts_ms", "seq")

    T.lock_stream(hits(), T.lock_state(spark, work_dir(spark, "locks")), starts)
    T.arrival_stream(hits(), arrivals)
    live = R.live_only(T.live_hits(tables.sensor_log, tables.configs))
    batch = L.first_arrivals(live).select(*RUN_KEY, F.col("arrival_ms").alias("ts_ms"), "seq")
    want = locked([((h.pipeline_id, h.schedule_id, h.exec_date), h.ts_ms, h.seq) for h in live.collect()])
    got = sorted(((h.pipeline_id, h.schedule_id, h.exec_date), h.ts_ms, h.seq) for h in starts.read(spark).collect())
    assert got == [h[:3] for h in want]
    assert rows(batch) == rows(T.first_arrivals(arrivals.read(spark)))


def test_lock_chains_over_batches(spark):
    r = random.Random(5)
    hits = [("hot" if k % 3 else r.choice("abc"), r.randrange(400_000_000), k) for k in range(600)]
    df = spark.createDataFrame(hits, "pipeline_id string, ts_ms long, seq long").withColumns(
        {"schedule_id": F.lit("s"), "exec_date": F.lit("d")}).select(*RUN_KEY, "ts_ms", "seq")
    path = work_dir(spark, "hits")
    in_order(df, path, "ts_ms", 4)
    starts = T.StateTable(spark, work_dir(spark, "starts"), T.START_DDL)
    T.lock_stream(T.read_stream(spark, path, df.schema, files_per_batch=1), T.lock_state(spark, work_dir(spark, "locks")), starts)
    assert sorted((h.pipeline_id, h.ts_ms, h.seq) for h in starts.read(spark).collect()) == [h[:3] for h in locked(hits)]


def test_retries_over_batches(spark, tables):
    """Retries streamed in four micro-batches equal the batch, and a micro-batch reads no more files than one before."""
    path = work_dir(spark, "job-log")
    in_order(tables.job_log, path, "event_ms", 4)
    routes = T.StateTable(spark, work_dir(spark, "routes"), T.ROUTE_DDL)
    retries = T.StateTable(spark, work_dir(spark, "retries"), T.RETRY_DDL)
    runs = run_states(spark, tables, tables.job_log.limit(0), buckets=2, deltas=2)
    read = []
    lookup = runs.used.lookup

    def counted(keys, batch_id):
        out = lookup(keys, batch_id)
        read.append(len(out.inputFiles()))
        return out

    runs.used.lookup = counted
    T.job_stream(T.read_stream(spark, path, tables.job_log.schema, files_per_batch=1), lambda: tables.configs, runs,
                 routes, retries)
    cols = [*RUN_KEY, "event_ms", "seq", "event", "category", "rerun_count", "max_retries", "decision", "event_type", "new_status"]
    batch = N.retry_decisions(tables.job_log, tables.configs, tables.reruns, tables.triggers)
    assert rows(retries.read(spark).select(*cols)) == rows(batch.select(*cols))
    assert len(read) == 4 and max(read) <= 4  # two buckets of two parts
    routed = N.route_job_events(tables.job_log).select(*RUN_KEY, "event_ms", "seq", "event", "route", "event_type")
    assert rows(routes.read(spark)) == rows(routed)
    prior = N.retries_used(tables.reruns.select(*RUN_KEY, "reason").unionByName(batch.filter(
        F.col("decision").isin("retry", "retry_without_lock")).select(*RUN_KEY, F.lit(N.RETRY_REASON).alias("reason"))))
    assert rows(runs.used.read(spark)) == rows(prior)
    ended = batch.filter("new_status = 'FAILED_FINAL'").select(*RUN_KEY).distinct()
    late = runs.triggers.read(spark).join(ended, RUN_KEY)
    assert late.count() and not late.filter("status = 'RUNNING' and ttl_epoch is null").count()


def test_retry_budget_lasts_over_batches(spark, tables):
    """A run that fails in every micro-batch is retried as often as its config allows, and no more."""
    one = N.retry_decisions(tables.job_log, tables.configs, tables.reruns.limit(0), tables.triggers).filter(
        "decision = 'retry' and max_retries between 1 and 3 and category <> 'PERMANENT'").orderBy("event_ms", "seq").first()
    day = 86_400_000
    log = tables.job_log.filter((F.col("seq") == one.seq) & (F.col("event_ms") == one.event_ms)).withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("event_ms", F.col("event_ms") + F.col("k") * day).drop("k")
    path = work_dir(spark, "job-log")
    for k in range(6):
        log.filter(F.col("event_ms") == one.event_ms + k * day).coalesce(1).write.mode("append").parquet(path)
    runs = T.RunStates(spark, work_dir(spark, "runs"), log.limit(0), tables.reruns.limit(0), tables.triggers)
    retries = T.StateTable(spark, work_dir(spark, "retries"), T.RETRY_DDL)
    T.job_stream(T.read_stream(spark, path, log.schema, files_per_batch=1), lambda: tables.configs, runs,
                 T.StateTable(spark, work_dir(spark, "routes"), T.ROUTE_DDL), retries)
    got = [r.decision for r in retries.read(spark).orderBy("event_ms").collect()]
    assert got == ["retry"] * one.max_retries + ["exhausted"] * (6 - one.max_retries)
    assert runs.triggers.read(spark).join(log.select(*RUN_KEY).limit(1), RUN_KEY).first().status == "FAILED_FINAL"


def state_rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k BIGINT, x STRING")


def test_keyed_state(spark):
    s = KeyedState(spark, work_dir(spark, "state"), "k BIGINT, x STRING", ["k"], by=["k"], buckets=3, deltas=2)
    s.seed(state_rows(spark, *[(k, "seed") for k in range(20)]))
    want = {k: "seed" for k in range(20)}
    for n in range(9):
        new = {k: f"v{n}" for k in range(n, 20, 4)} | {100 + n: "new"}
        gone = [n, 100 + n - 2] if n > 3 else []
        s.update(state_rows(spark, *[p for p in new.items() if p[0] not in gone]), n,
                 gone=spark.createDataFrame([(k,) for k in gone], "k BIGINT"))
        want = {k: v for k, v in (want | new).items() if k not in gone}
        asked = state_rows(spark, *[(k, "") for k in (0, 5, n, 100 + n, 999)])
        got = s.lookup(asked, n + 1)
        assert {r.k: r.x for r in got.collect()} == {k: want[k] for k in (0, 5, n, 100 + n) if k in want}
        assert len(got.inputFiles()) <= 3 * 2 * 4  # three buckets of at most three parts, few files each
    assert {r.k: r.x for r in s.read(spark).collect()} == want
    # A replayed micro-batch sees the state before it, not its own first try.
    before = {r.k: r.x for r in s.lookup(state_rows(spark, (0, "")), 9).collect()}
    s.update(state_rows(spark, (0, "first try")), 9)
    assert {r.k: r.x for r in s.lookup(state_rows(spark, (0, "")), 9).collect()} == before
    s.update(state_rows(spark, (1, "second try")), 9)
    assert {r.k: r.x for r in s.read(spark).collect()} == want | {1: "second try"}
    s.carry(spark, 10)
    assert {r.k: r.x for r in s.read(spark).collect()} == want | {1: "second try"}


def test_empty_keyed_state(spark):
    s = KeyedState(spark, work_dir(spark, "state"), "k BIGINT, x STRING", ["k"], by=["k"])
    assert s.read(spark).count() == 0 == s.lookup(state_rows(spark, (1, "a")), 0).count()
    s.update(state_rows(spark), 0)
    assert s.lookup(state_rows(spark, (1, "a")), 1).count() == 0


def test_hours_and_alarms_over_batches(spark, tables, sensor_parts):
    hours = T.StateTable(spark, work_dir(spark, "hours"), T.HOUR_DDL)
    T.hourly_stream(sensor_parts().select("pipeline_id", "ts", "ts_ms"), hours)
    batch = tables.sensor_log.groupBy("pipeline_id", F.date_format("ts", "yyyy-MM-dd'T'HH").alias("exec_date")).agg(
        F.count("*").alias("n_rows"), F.max("ts_ms").alias("last_ms"))
    assert rows(T.hourly_runs(hours.read(spark))) == rows(batch)

    def metrics(df):
        return df.select(F.col("sensor_key").alias("name"), F.when(F.col("seq") % 2 == 0, "max").otherwise("sum").alias("stat"),
                         F.lit(3.0).alias("threshold"), "ts", F.lit(1.0).alias("value"))

    periods = T.StateTable(spark, work_dir(spark, "periods"), T.PERIOD_DDL)
    T.alarm_stream(metrics(sensor_parts()), periods)
    cols = ["name", "stat", "threshold", "period_start", "value", "alarm"]
    assert rows(E.merge_periods(periods.read(spark)).select(*cols)) == rows(E.alarm_periods(metrics(tables.sensor_log)).select(*cols))


@pytest.mark.parametrize("order", ["events first", "mixed"])
def test_polls_over_batches(spark, tables, order):
    starts = L.latest_job_events(tables.job_log).select(*RUN_KEY, (F.col("event_ms") - 1_800_000).alias("passed_ms"))
    changes = T.poll_changes(tables.job_log, starts)
    when = {"events first": F.col("passed_ms").isNotNull().cast("int"),
            "mixed": F.pmod(F.xxhash64(*changes.columns), F.lit(3)).cast("int")}[order]
    path = work_dir(spark, "changes")
    for k in range(3):
        changes.filter(when == k).coalesce(1).write.mode("append").parquet(path)
    seen = T.StateTable(spark, work_dir(spark, "visible"), T.JOB_EVENT_DDL)
    states = T.PollStates(spark, work_dir(spark, "polls"), buckets=3, deltas=2)
    T.poll_stream(T.read_stream(spark, path, changes.schema, files_per_batch=1), lambda: tables.configs, states, seen)
    assert rows(J.poll_replay(starts, tables.configs, seen.read(spark))) == rows(
        J.poll_replay(starts, tables.configs, tables.job_log))
    assert states.pending.read(spark).count() == 0 and rows(states.starts.read(spark)) == rows(starts)


def test_events_of_a_run_that_never_starts_stay_pending(spark, tables):
    changes = T.poll_changes(tables.job_log, L.latest_job_events(tables.job_log).limit(0).withColumn(
        "passed_ms", F.col("event_ms")))
    path = work_dir(spark, "changes")
    in_order(changes, path, "event_ms", 2)
    seen = T.StateTable(spark, work_dir(spark, "visible"), T.JOB_EVENT_DDL)
    states = T.PollStates(spark, work_dir(spark, "polls"))
    T.poll_stream(T.read_stream(spark, path, changes.schema, files_per_batch=1), lambda: tables.configs, states, seen)
    assert seen.read(spark).count() == 0
    assert rows(states.pending.read(spark)) == rows(tables.job_log.select(*RUN_KEY, "event_ms", "seq", "event"))


def test_a_change_is_reported_once_over_ticks(spark, tables):
    path = work_dir(spark, "ticks")
    for minute in (0, 5, 10):
        spark.range(1).select((tables.now + F.expr(f"INTERVAL {minute} MINUTES")).alias("ts")).coalesce(1).write.mode(
            "append").parquet(path)
    stale = tables.triggers.filter("status = 'RUNNING'").select(*RUN_KEY, "status", F.lit(1).cast("bigint").alias("ttl_epoch"))

    def checks(now, triggers, markers):
        return {"stale": W.stale_runs(triggers, tables.configs, now=now).select(F.lit("stale").alias("check"), *RUN_KEY, "event_type")}

    found = T.StateTable(spark, work_dir(spark, "findings"), T.FINDING_DDL)
    T.watchdog_stream(T.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1), checks, lambda: stale, found)
    assert 0 < found.read(spark).count() == found.read(spark).select(*RUN_KEY).distinct().count()


def test_stale_runs_get_no_plan(spark, tables):
    none = tables.triggers.limit(0)
    planned = L.plan_alerts(tables.configs, none, tables.job_log.limit(0), now=tables.now).select(*RUN_KEY).limit(3)
    triggers = planned.select(*RUN_KEY, F.lit("RUNNING").alias("status"), F.lit(1).cast("bigint").alias("ttl_epoch"))
    markers = spark.createDataFrame([], "check string, pipeline_id string, exec_date string")
    arrivals = L.first_arrivals(R.live_only(T.live_hits(tables.sensor_log, tables.configs)))
    baselines = spark.createDataFrame([], f"{T.RUN_DDL}, rule_key string, captured_ms bigint")
    found = W.union_findings(W.all_findings(tables.configs, tables.sensors, triggers, tables.job_log.limit(0), baselines,
                                            arrivals, markers, now=tables.now)).join(planned, RUN_KEY, "left_semi")
    assert {r.check for r in found.collect()} - {"missed_schedule"} == {"stale"}


def test_excluded_and_observation_only_hits_record_no_arrival(tables):
    hits = T.live_hits(tables.sensor_log, tables.configs)
    assert hits.filter("excluded").count() and hits.filter("cfg.dryRun").count()
    live = R.live_only(hits)
    assert live.filter("excluded or cfg.dryRun").count() == 0
    apart = hits.select(*RUN_KEY).distinct().join(live.select(*RUN_KEY), RUN_KEY, "left_anti")
    assert apart.count() and not L.first_arrivals(live).join(apart, RUN_KEY, "left_semi").count()
