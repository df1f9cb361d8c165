"""Order-dependent decisions against plain sequential loops, and skew-safe helpers against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from slipway.functions.ordered import as_of, running_before
from slipway.operators import accounting as Q, reruns as N, watchdog as W
from slipway.schema import CONFIG_STRUCT

RUN = "pipeline_id string, schedule_id string, exec_date string"


def test_as_of_matches_brute_force(spark):
    rnd = random.Random(1)
    facts = [(rnd.choice("ab"), rnd.randrange(20_000_000), i) for i in range(400)]
    probes = [(rnd.choice("abc"), rnd.randrange(20_000_000), i) for i in range(200)]
    f = spark.createDataFrame(facts, "k string, ms bigint, seq bigint")
    p = spark.createDataFrame(probes, "k string, at bigint, id bigint")
    out = as_of(p, f, ["k"], probe_ms="at", fact_ms="ms", fact_order=["seq"], payload=["seq"], out="hit")
    got = {r.id: r.hit.seq if r.hit else None for r in out.collect()}
    for k, at, i in probes:
        past = [(ms, seq) for fk, ms, seq in facts if fk == k and ms <= at]
        assert got[i] == (max(past)[1] if past else None)


def test_running_before_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), rnd.randrange(9_000_000), i, rnd.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ms bigint, seq bigint, flag boolean")
    out = running_before(df, ["k"], "ms", ["seq"], {"n": F.lit(1), "flags": F.col("flag")}, bucket_ms=1_000_000)
    for r in out.collect():
        past = [x for x in rows if x[0] == r.k and (x[1], x[2]) < (r.ms, r.seq)]
        assert (r.n, r.flags) == (len(past), sum(x[3] for x in past))


def configs(spark, jobs):
    rows = [(p, '{"pipeline":{"id":"%s"},"schedule":{},"job":%s}' % (p, job)) for p, job in jobs.items()]
    return spark.createDataFrame(rows, "pipeline_id string, j string").select(
        "pipeline_id", F.from_json("j", CONFIG_STRUCT).alias("cfg"))


def sensors(spark, rows):
    df = spark.createDataFrame(rows, "pipeline_id string, sensor_key string, j string")
    return df.select("pipeline_id", "sensor_key", F.from_json("j", "map<string,variant>").alias("data"))


@pytest.mark.parametrize("seed", [3, 4])
def test_rerun_decisions_match_a_sequential_pass(spark, seed):
    rnd = random.Random(seed)
    jobs = {f"p{i}": (rnd.randrange(4), rnd.randrange(3)) for i in range(8)}
    reqs, log, locks, prior = [], [], [], []
    fresh_ms = {p: rnd.choice([500, 1500]) for p in jobs}
    for p in jobs:
        if rnd.random() < 0.6:
            locks.append((p, "stream", "2024-01-01", "COMPLETED"))
        for i in range(rnd.randrange(1, 12)):
            reqs.append((p, "stream", "2024-01-01", rnd.randrange(1000), len(reqs),
                         rnd.choice(["data-drift", "late-data", "manual", "", "other"])))
        for i in range(rnd.randrange(4)):
            log.append((p, "stream", "2024-01-01", rnd.randrange(1000), len(log), rnd.choice(["success", "success", "fail"])))
        for i in range(rnd.randrange(2)):
            prior.append((p, "stream", "2024-01-01", rnd.choice(["data-drift", "manual"])))
    got = {r.seq: (r.decision, r.reject_reason, r.attempt) for r in N.rerun_decisions(
        spark.createDataFrame(reqs, f"{RUN}, requested_ms bigint, seq bigint, reason string"),
        configs(spark, {p: '{"type":"glue","maxDriftReruns":%d,"maxManualReruns":%d}' % b for p, b in jobs.items()}),
        spark.createDataFrame(prior, f"{RUN}, reason string"),
        spark.createDataFrame(log, f"{RUN}, event_ms bigint, seq bigint, event string"),
        spark.createDataFrame(locks, f"{RUN}, status string"),
        sensors(spark, [(p, "s", '{"updatedAt":"%d"}' % (fresh_ms[p] * 10**9)) for p in jobs if fresh_ms[p] > 1000]
                + [(p, "s", '{"updatedAt":"-1"}') for p in jobs if fresh_ms[p] < 1000])).collect()}
    for p, (drift, manual) in jobs.items():
        reruns = [x[3] for x in prior if x[0] == p]
        has_lock = any(x[0] == p for x in locks)
        events = sorted((x[3], 0, x[4], x[5]) for x in log if x[0] == p)
        written = []
        rows = sorted(((x[3], x[5] or "manual", x[4]) for x in reqs if x[0] == p))
        for ms, reason, seq in rows:
            drift_class = reason in ("data-drift", "late-data")
            budget = drift if drift_class else manual
            count = sum(r in ("data-drift", "late-data") for r in reruns) if drift_class else reruns.count(reason)
            known = [e for e in events if e[0] <= ms] + written
            last = max(known, default=(0, 0, 0, None))[3]
            if count >= budget:
                want = ("rejected", f"{'drift' if drift_class else 'manual'} rerun limit exceeded", None)
            elif last == "success" and fresh_ms[p] < 1000:
                want = ("rejected", "previous run succeeded and no sensor data has changed", None)
            elif not has_lock:
                want = ("infra_failure", None, None)
            else:
                want = ("accepted", None, len(reruns))
                reruns.append(reason)
            if want[0] != "infra_failure":
                written.append((ms, 1, len(written), want[0]))
            assert got[seq] == want, (p, ms, reason)


@pytest.mark.parametrize("seed", [5, 6])
def test_retry_decisions_match_a_sequential_pass(spark, seed):
    rnd = random.Random(seed)
    jobs = {f"p{i}": (rnd.randrange(5), rnd.randrange(4)) for i in range(10)}
    log = [(rnd.choice(list(jobs)), "stream", "2024-01-01", rnd.randrange(10_000), i, "fail", None,
            rnd.choice(["PERMANENT", "TRANSIENT"])) for i in range(90)]
    prior = [(rnd.choice(list(jobs)), "stream", "2024-01-01", "job-fail-retry") for _ in range(8)]
    out = N.retry_decisions(
        spark.createDataFrame(log, f"{RUN}, event_ms bigint, seq bigint, event string, error string, category string"),
        configs(spark, {p: '{"type":"glue","maxRetries":%d,"maxCodeRetries":%d}' % b for p, b in jobs.items()}),
        spark.createDataFrame(prior, f"{RUN}, reason string"),
        spark.createDataFrame([("p0", "stream", "2024-01-01", "RUNNING")], f"{RUN}, status string"))
    got = {r.seq: (r.rerun_count, r.decision) for r in out.collect()}
    for p, (retries, code) in jobs.items():
        count = sum(x[0] == p for x in prior)
        for row in sorted((x for x in log if x[0] == p), key=lambda x: (x[3], x[4])):
            limit = code if row[7] == "PERMANENT" else retries
            want = (count, "exhausted") if count >= limit else (count, "retry" if p == "p0" else "retry_without_lock")
            assert got[row[4]] == want
            count += count < limit


def test_ten_record_batch(spark):
    rows = [(0, None, True)] * 5 + [(0, "schema", True)] * 3 + [(0, "timeout", True), (0, "schema", False)]
    df = spark.createDataFrame(rows, "batch_id int, error_kind string, dlq_ok boolean")
    r = Q.batch_stats(Q.split_outcomes(df)).first()
    assert (r.processed, r.dead_lettered, r.retried, r.total, r.balanced) == (5, 3, 2, 10, True)


def test_reconcile_states(spark):
    sent = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    outcomes = spark.createDataFrame([(1, 0, "ACKED"), (1, 1, "REJECTED"), (2, 0, "PENDING"), (9, 0, "ACKED")],
                                     "id bigint, n int, target string")
    got = {r.id: (r.state, r.n_invalid) for r in Q.reconcile(sent, outcomes, order=["n"]).collect()}
    assert got == {1: ("ACKED", 1), 2: ("PENDING", 1), 3: ("PENDING", 0), 9: ("UNKNOWN", 1)}


def test_stale_boundaries(spark):
    t = spark.createDataFrame([("p", "cron", "2024-01-01", "RUNNING", ttl) for ttl in (99, 100, 101, 0)],
                              f"{RUN}, status string, ttl_epoch bigint")
    out = W.stale_runs(t, configs(spark, {"p": '{"type":"glue"}'}), now=F.timestamp_seconds(F.lit(100)))
    assert [r.ttl_epoch for r in out.collect()] == [99]


def test_failing_check_does_not_stop_the_others(spark, tmp_path):
    ok = spark.createDataFrame([("a", "p", "cron", "2024-01-01", "X")], f"check string, {RUN}, event_type string")
    bad = ok.withColumn("event_type", F.raise_error(F.lit("boom")).cast("string"))
    findings, status = W.run_checks({"bad": bad, "good": ok}, str(tmp_path / "f"))
    row = status.first()
    assert findings.count() == 1 and row.healthy is False and row.event_type == "WATCHDOG_DEGRADED"
    assert row.checks["good"] == "ok"


def test_run_outcomes_replay_readiness_once(spark):
    """The first passing tick of each run, without rules as well; the outcome reads the stored replay and no sensor."""
    from slipway.operators import runs as J

    def cfg(p, mode, rules):
        return (p, f'{{"pipeline": {{"id": "{p}"}}, "schedule": {{"evaluation": {{"window": "10m", "interval": "5m"}}}}, '
                   f'"validation": {{"trigger": "{mode}", "rules": [{rules}]}}, "job": {{"type": "command"}}}}')

    rule = '{"key": "rows", "check": "gte", "field": "count", "value": 10}'
    conf = spark.createDataFrame([cfg("p1", "ALL", rule), cfg("p2", "ALL", ""), cfg("p3", "ANY", ""), cfg("p4", "ALL", rule)],
                                 "pipeline_id string, text string").select(
        "pipeline_id", F.from_json("text", CONFIG_STRUCT).alias("cfg"))
    runs = spark.createDataFrame([(f"p{n}", "stream", "2024-01-05", 1_000_000) for n in (1, 2, 3, 4)] + [("p1", "stream", None, 1_000_000)],
                                 "pipeline_id string, schedule_id string, exec_date string, start_ms long")
    sensors = spark.createDataFrame([("p1", "rows", 1_200_000, 1, '{"count": 12}')],
                                    "pipeline_id string, sensor_key string, ts_ms long, seq long, j string").withColumn(
        "data", F.from_json("j", "map<string,variant>")).drop("j")
    ready = J.readiness_replay(runs, conf, sensors).select("pipeline_id", "exec_date", "tick", "passed_ms", "evaluations")
    day = "2024-01-05"
    assert sorted(ready.collect(), key=str) == sorted([
        ("p1", day, 1, 1_300_000, 2), ("p1", None, None, None, 2), ("p2", day, 0, 1_000_000, 1), ("p3", day, None, None, 2),
        ("p4", day, None, None, 2)], key=str)
    log = spark.createDataFrame([], "pipeline_id string, schedule_id string, exec_date string, event_ms long, seq long, event string")
    out = J.run_outcomes(runs, conf, sensors, log)
    assert "Window [" not in out._jdf.queryExecution().analyzed().toString()
