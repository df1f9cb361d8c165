"""The live post-run path against a sequential walk over the changes."""

import random

import pytest
from pyspark.sql import functions as F

from slipway.session import work_dir
from slipway.schema import CONFIG_STRUCT
from slipway.streaming import jobs as T, postrun as P

MINUTE = 60_000
DAY = "2024-01-15"  # a Monday
START = 1_705_276_800_000
RUN = [("p0", "stream"), ("p1", "cron"), ("p2", "stream")]


def configs(spark):
    """Drift above 5; p1 excludes the day; p2 has two rules, of which the second asks for a sensor with another key."""
    def text(n):
        rules = '{"key": "rows", "check": "gte", "field": "count", "value": 10}'
        if n == 2:
            rules += ', {"key": "flag", "check": "equals", "field": "state", "value": "ok"}'
        exclude = f', "exclude": {{"dates": ["{DAY}"]}}' if n == 1 else ""
        cron = '"cron": "0 6 * * *", ' if n == 1 else ""
        return (f'{{"pipeline": {{"id": "p{n}"}}, "schedule": {{{cron}"trigger": {{"key": "start", "check": "exists"}}{exclude}}},'
                ' "validation": {"trigger": "ALL", "rules": []}, "job": {"type": "command", "config": {"command": "x"}},'
                f' "postRun": {{"rules": [{rules}], "driftField": "count", "driftThreshold": 5}}}}')

    rows = spark.createDataFrame([(f"p{n}", text(n)) for n in range(3)], "pipeline_id STRING, text STRING")
    return rows.select("pipeline_id", F.from_json("text", CONFIG_STRUCT).alias("cfg"))


def some_changes(seed, n=260):
    r = random.Random(seed)
    at = sorted(r.sample(range(24 * 60 * 60), n))
    out = []
    for seq, second in enumerate(at):
        p, _ = RUN[r.randrange(3)]
        kind = r.choices(["sensor", "status", "completion", "reset"], [8, 2, 2, 1])[0]
        value = None
        if kind == "sensor":
            key = r.choice(["rows", f"rows#{DAY}", "rows#20240115", "flag", "other"])
            value = (key, '{"state": "%s", "date": "%s"}' % (r.choice(["ok", "ok", "bad"]), DAY) if key == "flag" else
                     '{"count": %d, "date": "%s"}' % (r.choice([4, 10, 12, 14, 19, 30]), DAY))
        elif kind == "status":
            value = r.choice(["RUNNING", "COMPLETED", "COMPLETED", "FAILED_FINAL"])
        out.append((kind, p, START + second * 1000, seq, value))
    return out


def walk(changes):
    """One change after the other, with plain dictionaries."""
    import json

    sensors, status, base, out = {}, {}, {}, []
    rules = {"p0": ["rows"], "p1": ["rows"], "p2": ["rows", "flag"]}

    def answer(p, key):
        for k in (f"{key}#{DAY}", f"{key}#20240115", key):
            if (p, k) in sensors:
                return sensors[p, k]
        return None

    def passes(p, key):
        data = answer(p, key)
        return data is not None and (data["count"] >= 10 if key == "rows" else data["state"] == "ok")

    for kind, p, at, seq, value in changes:
        if kind == "status":
            status[p] = value
        elif kind == "completion":
            for k in rules[p]:
                if answer(p, k) is not None:
                    base[p, k] = answer(p, k)
        elif kind == "reset":
            base = {k: v for k, v in base.items() if k[0] != p}
        else:
            sensor, data = value[0], json.loads(value[1])
            sensors[p, sensor] = data
            rule = next((k for k in rules[p] if sensor.startswith(k)), None)
            if rule is None or status.get(p) not in ("RUNNING", "COMPLETED"):
                continue
            old, new = base.get((p, rule), {}).get("count"), data.get("count")
            drifted = old is not None and new is not None and abs(new - old) > 5
            if drifted and status[p] == "RUNNING":
                out.append((p, seq, "POST_RUN_DRIFT_INFLIGHT", None))
            elif drifted:
                out.append((p, seq, "POST_RUN_DRIFT", "PIPELINE_EXCLUDED" if p == "p1" else "data-drift"))
            elif status[p] == "COMPLETED":
                ok = all(passes(p, k) for k in rules[p])
                out.append((p, seq, "POST_RUN_PASSED" if ok else "POST_RUN_FAILED", None))
    return sorted(out, key=str)


def frame(spark, changes):
    schedule = dict(RUN)
    rows = [(kind, p, None if kind == "sensor" else schedule[p], None if kind == "sensor" else DAY,
             value[0] if kind == "sensor" else None, value[1] if kind == "sensor" else None, at, seq,
             value if kind == "status" else None) for kind, p, at, seq, value in changes]
    df = spark.createDataFrame(rows, f"kind STRING, {T.RUN_DDL}, sensor_key STRING, text STRING, at_ms BIGINT, seq BIGINT, status STRING")
    return df.select("kind", "pipeline_id", "schedule_id", "exec_date", "sensor_key",
                     F.from_json("text", "MAP<STRING, VARIANT>").alias("data"), F.timestamp_millis("at_ms").alias("ts"),
                     "at_ms", "seq", "status")


def found(df):
    return sorted(((r.pipeline_id, r.seq, r.event_type, r.follow_up) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_post_run_as_a_batch_equals_a_walk(spark, seed):
    changes = some_changes(seed)
    want = walk(changes)
    assert {w[2] for w in want} == {"POST_RUN_DRIFT_INFLIGHT", "POST_RUN_DRIFT", "POST_RUN_PASSED", "POST_RUN_FAILED"}
    assert {w[3] for w in want} == {None, "data-drift", "PIPELINE_EXCLUDED"}
    assert found(P.post_run_batch(frame(spark, changes), configs(spark))) == want


def test_post_run_over_batches_equals_a_walk(spark):
    changes = some_changes(5)
    path = work_dir(spark, "changes")
    for k in range(4):
        frame(spark, changes[k * 65:(k + 1) * 65]).coalesce(1).write.mode("append").parquet(path)
    out = T.StateTable(spark, work_dir(spark, "outcomes"), P.OUTCOME_DDL)
    states = P.PostRunStates(spark, work_dir(spark, "states"), buckets=3, deltas=2)
    P.post_run_stream(T.read_stream(spark, path, frame(spark, []).schema, files_per_batch=1), lambda: configs(spark), states, out)
    assert found(out.read(spark)) == walk(changes)
    assert states.statuses.read(spark).count() <= 3 and states.baselines.read(spark).count() <= 4  # one row per run and rule


def test_post_run_without_rows(spark):
    assert P.post_run_batch(frame(spark, []), configs(spark)).count() == 0
    writes = [c for c in some_changes(1) if c[0] == "sensor"]
    assert P.post_run_batch(frame(spark, writes), configs(spark)).count() == 0  # no run has a status


def test_checked_writes_are_worked_out_once(spark):
    """Only the as-of lookup of the rules' sensors is left behind the stored writes; its windows are a bucket's and a key's."""
    plan = P.post_run_batch(spark.createDataFrame([], P.CHANGE_DDL), configs(spark))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Window [") == 2
