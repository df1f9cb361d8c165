"""Streaming queries over the event table, each compared with the batch result of the same log."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipway.operators import sla as L
from slipway.plans.decisions import FAILX, KEYS, N4_SQL, N5_SQL, N6_SQL, N7_SQL, REQX, arrivals, baselines
from slipway.plans.history import E4_SQL, EVENTS, PERIODS, POLL_STARTS, W1_SQL, W2_ALL, W3_SQL, W4_SQL, W5_BASE, W5_SQL, _alarm_metrics, _decision_events
from slipway.plans.base import EVENT_SQL, LAST_FIRE, _job_events
from slipway.plans.decisions import D8_SQL, L9_SQL, PLAN, TIMERS, _daily_timers, deadline_sql, run_day
from slipway.plans.registry import Tables, query, secs
from slipway.plans.views import excluded, local
from slipway.operators import events as E, rules as R, runs as J, watchdog as W
from slipway.operators.timers import NAME_KEY
from slipway.schema import LOCK_SECONDS, RUN_KEY
from slipway.session import work_dir
from slipway.sources import fixtures as X
from slipway.streaming import eventlog as G, jobs as T, postrun as P, timers as C


def sensor_stream(t: Tables):
    events = t.table("events")
    return X.from_events(T.read_stream(t.spark, t.sf_dir, events.schema, name="events.parquet"))


def stream_of(t: Tables, name: str, make=None):
    """Stream over a stored table."""
    df = t.stored(name, make) if make else getattr(t, name)
    return T.read_stream(t.spark, t.path(name), df.schema)


def state(t: Tables, name: str, ddl: str):
    return T.StateTable(t.spark, work_dir(t.spark, name), ddl)


STARTED_SQL = f"""
    SELECT {KEYS}, ts_ms, seq FROM hits h WHERE NOT dry_run AND NOT {excluded(local('h.ts', 'h.tz'), 'h')}
    QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY ts_ms, seq) = 1"""


def locks_sql(free: str) -> dict[str, str]:
    """Views of the hits that take their run's lock, one after the other, as a recursive query over the free ones."""
    same = "{a}.pipeline_id = {b}.pipeline_id AND {a}.schedule_id = {b}.schedule_id AND {a}.exec_date = {b}.exec_date"
    return {
        "lk": f"""SELECT {KEYS}, ts_ms, seq, ts_ms // 1000 AS s FROM hits h
          WHERE NOT dry_run AND NOT {excluded(local('h.ts', 'h.tz'), 'h')} AND {free}
          QUALIFY row_number() OVER (PARTITION BY {KEYS}, ts_ms // 1000 ORDER BY ts_ms, seq) = 1""",
        "lnext": f"""SELECT a.*, b.s AS nxt FROM lk a ASOF LEFT JOIN lk b
          ON {same.format(a='a', b='b')} AND a.s + {LOCK_SECONDS} <= b.s""",
        "taken": f"""WITH RECURSIVE c AS (
          (SELECT * FROM lnext QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY s) = 1)
          UNION ALL SELECT n.* FROM c JOIN lnext n ON {same.format(a='c', b='n')} AND n.s = c.nxt)
          SELECT {KEYS}, ts_ms, seq FROM c""",
    }


FREE = f"""NOT EXISTS (SELECT 1 FROM trig t WHERE t.pipeline_id = h.pipeline_id AND t.schedule_id = h.schedule_id
      AND t.exec_date = h.exec_date AND (t.ttl_epoch IS NULL OR t.ttl_epoch > h.ts_ms // 1000))"""


@query("t1_live_triggers", f"""
    SELECT h.*, 'JOB_TRIGGERED' AS event_type FROM taken h
    UNION ALL SELECT {KEYS}, ts_ms, seq, 'PIPELINE_EXCLUDED' FROM hits h
      WHERE NOT dry_run AND {excluded(local('h.ts', 'h.tz'), 'h')}""", locks_sql(FREE))
def t1(t: Tables):
    starts = state(t, "starts", T.START_DDL)
    events = state(t, "trigger-events", f"{T.START_DDL}, event_type STRING")
    T.trigger_stream(sensor_stream(t), lambda: t.configs, lambda: t.triggers,
                     T.lock_state(t.spark, work_dir(t.spark, "locks")), starts, events)
    return events.read(t.spark)


def _stream_hits(t: Tables):
    return R.live_only(T.live_hits(sensor_stream(t), t.configs)).select(*RUN_KEY, "ts", "ts_ms", "seq")


@query("t2_run_locks", f"SELECT {KEYS}, ts_ms, seq FROM taken", locks_sql("TRUE"))
def t2(t: Tables):
    """Every hit that starts its run: the first, and the first after each lock has ended."""
    out = state(t, "starts", T.START_DDL)
    T.lock_stream(_stream_hits(t), T.lock_state(t.spark, work_dir(t.spark, "locks")), out)
    return out.read(t.spark)


@query("t3_first_arrivals", STARTED_SQL)
def t3(t: Tables):
    out = state(t, "arrivals", f"{T.RUN_DDL}, ts_ms BIGINT, seq BIGINT")
    T.arrival_stream(_stream_hits(t), out)
    return T.first_arrivals(out.read(t.spark))


@query("t4_late_data", N6_SQL)
def t4(t: Tables):
    out = state(t, "late", f"{T.RUN_DDL}, ts_ms BIGINT, seq BIGINT, late_ms BIGINT")
    T.late_data_stream(sensor_stream(t), lambda: t.configs, lambda: t.triggers, lambda: t.job_log, out)
    return out.read(t.spark)


@query("t5_rerun_decisions", N4_SQL, {"reqx": REQX})
def t5(t: Tables):
    out = state(t, "decisions", T.DECISION_DDL)
    runs = T.RunStates(t.spark, work_dir(t.spark, "runs"), t.job_log, t.reruns, t.triggers, t.sensors)
    T.rerun_stream(stream_of(t, "rerun_requests"), lambda: t.configs, runs, out)
    return out.read(t.spark).select(*RUN_KEY, "requested_ms", "seq", "reason", "decision", "reject_reason", "attempt")


def _job_stream(t: Tables):
    routes, retries = state(t, "routes", T.ROUTE_DDL), state(t, "retries", T.RETRY_DDL)
    runs = T.RunStates(t.spark, work_dir(t.spark, "runs"), t.job_log.limit(0), t.reruns, t.triggers)
    T.job_stream(stream_of(t, "job_log"), lambda: t.configs, runs, routes, retries)
    return routes.read(t.spark), retries.read(t.spark)


@query("t5_live_retries", N5_SQL, {"failx": FAILX})
def t5_retries(t: Tables):
    """Retry decisions of failures as they arrive."""
    return _job_stream(t)[1].select(*RUN_KEY, "event_ms", "seq", "max_retries", "rerun_count", "decision")


@query("t5_live_routes", N7_SQL)
def t5_routes(t: Tables):
    return _job_stream(t)[0].select("route", "event_type", "pipeline_id", "exec_date", "seq")


def _no_marks(sql: str) -> str:
    return sql.replace("SELECT pipeline_id, exec_date FROM marks", "SELECT pipeline_id, exec_date FROM marks WHERE FALSE")


@query("t6_watchdog_ticks", f"""
    SELECT 'stale' AS check, {KEYS}, 'SFN_TIMEOUT' AS event_type FROM ({W1_SQL})
    UNION ALL SELECT 'missed_schedule', {KEYS}, 'SCHEDULE_MISSED' FROM ({W2_ALL}), (VALUES (1), (2)) tick(n)
    UNION ALL SELECT 'missed_inclusion', {KEYS}, 'IRREGULAR_SCHEDULE_MISSED' FROM ({_no_marks(W3_SQL)})
    UNION ALL SELECT 'recovered', {KEYS}, 'TRIGGER_RECOVERED' FROM w4r
    UNION ALL SELECT 'sla_plan', {KEYS}, NULL FROM ({deadline_sql(PLAN, "now_ts", "sla_date")}) p
      WHERE breach > now_ts AND NOT EXISTS (SELECT 1 FROM staled f WHERE f.pipeline_id = p.pipeline_id
        AND f.schedule_id = p.schedule_id AND f.exec_date = p.exec_date)
    UNION ALL SELECT 'window_expired', {KEYS}, 'SENSOR_DEADLINE_EXPIRED' FROM ({W5_SQL.format(known="known")})
    UNION ALL SELECT 'post_run_missing', {KEYS}, 'POST_RUN_SENSOR_MISSING' FROM ({_no_marks(D8_SQL)})
    UNION ALL SELECT 'relative_breach', {KEYS}, 'RELATIVE_SLA_BREACH'
      FROM ({_no_marks(L9_SQL.replace("finished", "failed_too"))})""",
       {"lf": LAST_FIRE, "w5b": W5_BASE, "w4r": W4_SQL,
        "known": f"SELECT {KEYS} FROM trig UNION ALL SELECT {KEYS} FROM w4r",
        "staled": f"SELECT {KEYS} FROM finished UNION SELECT {KEYS} FROM ({W1_SQL})",
        "failed_too": f"SELECT {KEYS} FROM staled UNION SELECT {KEYS} FROM ({W5_SQL.format(known='known')})"})
def t6(t: Tables):
    """Two ticks at one clock: the second repeats only the missed schedules."""
    out = state(t, "findings", T.FINDING_DDL)

    def checks(now, triggers, marks):
        return W.all_findings(t.configs, t.sensors, triggers, t.job_log, baselines(t), arrivals(t), marks, now=now)

    ticks = t.stored("ticks", lambda: t.sensor_log.groupBy().agg(F.max(t.now).alias("ts")).withColumn(
        "n", F.explode(F.array(F.lit(1), F.lit(2)))).repartitionByRange(2, "n"))
    T.watchdog_stream(T.read_stream(t.spark, t.path("ticks"), ticks.schema, files_per_batch=1), checks,
                      lambda: t.triggers, out)
    return out.read(t.spark)


def _timer_changes(t: Tables):
    """Timers planned as each day begins; a success cancels its run's; reruns open a run again; a tick per hour of the log."""
    again = t.reruns.select(*RUN_KEY, F.col("triggered_ms").alias("event_ms"), "seq", F.lit("rerun-accepted").alias("event"))
    hour = F.expr("ts_ms div 3600000") * 3_600_000 + 3_600_000
    return C.timer_changes(
        _daily_timers(t).withColumn("at_ms", F.unix_millis(run_day())),
        t.job_log.select(*RUN_KEY, "event_ms", "seq", "event").unionByName(again),
        arrivals(t).select(*RUN_KEY, F.col("arrival_ms").alias("at_ms"), "seq", F.lit("RUNNING").alias("status")),
        t.job_log.filter("event = 'success'").select(*RUN_KEY, F.col("event_ms").alias("at_ms")),
        t.sensor_log.select(hour.alias("tick_ms")).distinct())


@query("t6_live_timers", f"""
    SELECT f.pipeline_id, f.schedule_id, f.exec_date, name, alert_type, tick_ms AS fired_ms,
      CASE WHEN x.event IS NOT NULL AND x.event <> 'rerun-accepted' THEN 'finished'
        WHEN alert_type = 'SLA_WARNING' AND tick_ms >= breach_ms THEN 'late_warning' ELSE 'published' END AS outcome,
      CASE WHEN a.arrival_ms <= tick_ms THEN 'RUNNING' ELSE 'not started' END AS status,
      CASE WHEN a.arrival_ms <= tick_ms THEN 'pipeline running — may complete before breach'
        WHEN alert_type = 'SLA_BREACH' THEN 'pipeline not started — investigate trigger'
        ELSE 'pipeline not started — check sensor data' END AS action_hint
    FROM tmfired f
    ASOF LEFT JOIN tmevents x ON f.pipeline_id = x.pipeline_id AND f.schedule_id = x.schedule_id
      AND f.exec_date = x.exec_date AND f.tick_ms >= x.event_ms
    LEFT JOIN arrivals a ON a.pipeline_id = f.pipeline_id AND a.schedule_id = f.schedule_id AND a.exec_date = f.exec_date
    WHERE NOT EXISTS (SELECT 1 FROM jlog c WHERE c.event = 'success' AND c.pipeline_id = f.pipeline_id
      AND c.schedule_id = f.schedule_id AND c.exec_date = f.exec_date AND c.event_ms > f.plan_ms AND c.event_ms <= f.tick_ms)""",
       {"tmplans": f"""SELECT {KEYS}, name, alert_type, epoch_ms(fire_at) AS fire_ms,
            CASE alert_type WHEN 'SLA_WARNING' THEN epoch_ms(breach) END AS breach_ms,
            epoch_ms(CAST(exec_date AS TIMESTAMP)) AS plan_ms FROM ({TIMERS})""",
        "tmticks": "SELECT DISTINCT (ts_ms // 3600000 + 1) * 3600000 AS tick_ms FROM slog",
        "tmfired": "SELECT p.*, k.tick_ms FROM tmplans p ASOF JOIN tmticks k ON greatest(p.fire_ms, p.plan_ms) <= k.tick_ms",
        "tmevents": f"""SELECT * FROM (SELECT {KEYS}, event_ms, seq, event FROM jlog
            UNION ALL SELECT {KEYS}, triggered_ms, seq, 'rerun-accepted' FROM reruns)
          QUALIFY row_number() OVER (PARTITION BY {KEYS}, event_ms ORDER BY seq DESC) = 1"""})
def t6_timers(t: Tables):
    """Alert timers as they come due, with the outcome of each firing."""
    changes = stream_of(t, "timer_changes", lambda: _timer_changes(t))
    out = state(t, "alerts", C.ALERT_DDL)
    C.timer_stream(changes, C.TimerStates(t.spark, work_dir(t.spark, "timers")), out)
    return out.read(t.spark).select(*NAME_KEY, "alert_type", "fired_ms", "outcome", "status", "action_hint")


def _post_run_changes(t: Tables):
    """The sensor log; statuses from job events and reruns; each success captures, each rerun resets."""
    again = t.reruns.filter("reason <> 'job-fail-retry'").select(*RUN_KEY, F.col("triggered_ms").alias("at_ms"), "seq")
    ended = F.when(F.col("event") == "success", "COMPLETED").otherwise("FAILED_FINAL")
    events = t.job_log.select(*RUN_KEY, F.col("event_ms").alias("at_ms"), "seq", ended.alias("status"))
    return P.post_run_changes(t.sensor_log, events.unionByName(again.withColumn("status", F.lit("RUNNING"))),
                              events.filter("status = 'COMPLETED'"), again)


@query("d5_live_post_run", f"""
    SELECT {KEYS}, seq, CASE WHEN NOT drifted THEN CASE WHEN u % 3 <> 1 AND coalesce(now_value > 0, FALSE)
          THEN 'POST_RUN_PASSED' ELSE 'POST_RUN_FAILED' END
        WHEN run_status = 'COMPLETED' THEN 'POST_RUN_DRIFT' ELSE 'POST_RUN_DRIFT_INFLIGHT' END AS event_type,
      CASE WHEN drifted AND run_status = 'COMPLETED' THEN CASE WHEN excl THEN 'PIPELINE_EXCLUDED' ELSE 'data-drift' END END
        AS follow_up
    FROM prwrites WHERE drifted OR run_status = 'COMPLETED'""", {
    "prst": f"""SELECT * FROM (
        SELECT {KEYS}, event_ms AS at_ms, seq, CASE event WHEN 'success' THEN 'COMPLETED' ELSE 'FAILED_FINAL' END AS status FROM jlog
        UNION ALL SELECT {KEYS}, triggered_ms, seq, 'RUNNING' FROM reruns WHERE reason <> 'job-fail-retry')
      QUALIFY row_number() OVER (PARTITION BY {KEYS}, at_ms ORDER BY seq DESC) = 1""",
    "prbase": f"""SELECT l.pipeline_id, l.schedule_id, l.exec_date, l.event_ms AS captured_ms, s.value AS base_value
      FROM (SELECT DISTINCT {KEYS}, event_ms FROM jlog WHERE event = 'success') l
      JOIN cfg c USING (pipeline_id) JOIN slog s ON s.pipeline_id = l.pipeline_id
        AND s.event_type = 'purchase' AND s.ts_ms <= l.event_ms AND s.sensor_key IN ('purchase',
          'purchase#' || l.exec_date, 'purchase#' || replace(l.exec_date, '-', ''))
      WHERE c.has_post
      QUALIFY row_number() OVER (PARTITION BY l.pipeline_id, l.schedule_id, l.exec_date, l.event_ms ORDER BY
        CASE WHEN s.sensor_key = 'purchase' THEN 2 WHEN contains(s.sensor_key, '-') THEN 0 ELSE 1 END,
        s.ts_ms DESC, s.seq DESC) = 1""",
    "prnow": """SELECT pipeline_id, sensor_key, ts_ms, value FROM slog WHERE event_type = 'purchase'
      QUALIFY row_number() OVER (PARTITION BY pipeline_id, sensor_key, ts_ms ORDER BY seq DESC) = 1""",
    "prreset": f"SELECT DISTINCT {KEYS}, triggered_ms AS at_ms FROM reruns WHERE reason <> 'job-fail-retry'",
    "prwrites": f"""SELECT w.*, prst.status AS run_status, coalesce(abs(w.value - b.base_value) > w.drift_threshold
          AND (r.at_ms IS NULL OR b.captured_ms >= r.at_ms), FALSE) AS drifted, n.value AS now_value,
        {excluded("CAST(substr(w.exec_date, 1, 10) AS TIMESTAMP)", "w")} AS excl
      FROM (SELECT *, CASE u % 4 WHEN 2 THEN 'purchase#' || exec_date WHEN 3 THEN 'purchase#' || replace(exec_date, '-', '')
          ELSE 'purchase' END AS own_key FROM postm WHERE NOT dry_run) w
      ASOF JOIN prst ON w.pipeline_id = prst.pipeline_id AND w.schedule_id = prst.schedule_id
        AND w.exec_date = prst.exec_date AND w.ts_ms >= prst.at_ms
      ASOF LEFT JOIN prreset r ON w.pipeline_id = r.pipeline_id AND w.schedule_id = r.schedule_id
        AND w.exec_date = r.exec_date AND w.ts_ms >= r.at_ms
      ASOF LEFT JOIN prbase b ON w.pipeline_id = b.pipeline_id AND w.schedule_id = b.schedule_id
        AND w.exec_date = b.exec_date AND w.ts_ms > b.captured_ms
      ASOF LEFT JOIN prnow n ON w.pipeline_id = n.pipeline_id AND w.own_key = n.sensor_key AND w.ts_ms >= n.ts_ms
      WHERE prst.status IN ('RUNNING', 'COMPLETED')"""})
def d5_live(t: Tables):
    """Outcome of each sensor write after a run, as of the write: status, baseline version, drift or rules."""
    changes = stream_of(t, "post_run_changes", lambda: _post_run_changes(t))
    out = state(t, "post-run", P.OUTCOME_DDL)
    P.post_run_stream(changes, lambda: t.configs, P.PostRunStates(t.spark, work_dir(t.spark, "post-run")), out)
    return out.read(t.spark).select(*RUN_KEY, "seq", "event_type", "follow_up")


def _poll_starts(t: Tables):
    return L.latest_job_events(t.job_log).select(
        *RUN_KEY, (F.col("event_ms") - 1_800_000 - F.col("seq") % 5 * 1_000_000).alias("passed_ms"))


@query("t7_poll_loop", f"""
    SELECT {KEYS}, polls, outcome, finished_ms FROM (
      SELECT {KEYS}, coalesce(poll, n_polls) AS polls, coalesce(event, 'timeout') AS outcome,
        base_ms + coalesce(poll, n_polls) * 60000 AS finished_ms
      FROM (SELECT b.pipeline_id, b.schedule_id, b.exec_date, b.base_ms, b.n_polls, min(k) AS poll, arg_min(x.event, k) AS event
        FROM (SELECT s.*, CASE WHEN c.poll_window > 0 THEN CAST(ceil(c.poll_window / 60) AS BIGINT) ELSE 60 END AS n_polls
          FROM base s JOIN cfg c USING (pipeline_id)) b
        LEFT JOIN (SELECT s.pipeline_id, s.schedule_id, s.exec_date, j.event, greatest(1,
            CAST(ceil((j.event_ms - s.base_ms) / 60000) AS BIGINT)) AS k
          FROM base s JOIN jlog j USING ({KEYS})
          QUALIFY row_number() OVER (PARTITION BY s.pipeline_id, s.schedule_id, s.exec_date, k
            ORDER BY j.event_ms DESC, j.seq DESC) = 1) x
          ON x.pipeline_id = b.pipeline_id AND x.schedule_id = b.schedule_id AND x.exec_date = b.exec_date AND k <= b.n_polls
        GROUP BY ALL))""", {"base": POLL_STARTS})
def t7(t: Tables):
    """Poll outcomes from the job events each micro-batch makes visible; starts and events come as one stream."""
    def make():
        return T.poll_changes(t.job_log, _poll_starts(t))

    changes = stream_of(t, "poll_changes", make)
    out = state(t, "visible", T.JOB_EVENT_DDL)
    states = T.PollStates(t.spark, work_dir(t.spark, "polls"))
    T.poll_stream(changes, lambda: t.configs, states, out)
    return J.poll_replay(states.starts.read(t.spark), t.configs, out.read(t.spark)).select(
        *RUN_KEY, "polls", "outcome", "finished_ms")


@query("t8_hourly_runs", """
    SELECT pipeline_id, strftime(ts, '%Y-%m-%dT%H') AS exec_date, count(*) AS n_rows, max(ts_ms) AS last_ms FROM slog
    GROUP BY ALL""")
def t8(t: Tables):
    out = state(t, "hours", T.HOUR_DDL)
    T.hourly_stream(sensor_stream(t).select("pipeline_id", "ts", "ts_ms"), out)
    return T.hourly_runs(out.read(t.spark))


@query("t9_fresh_configs", f"SELECT {KEYS}, ts_ms, seq FROM hits")
def t9(t: Tables):
    out = state(t, "hits", f"{T.RUN_DDL}, ts_ms BIGINT, seq BIGINT")
    T.hits_with_fresh_configs(sensor_stream(t), lambda: t.configs, out)
    return out.read(t.spark)


@query("t10_alarm_stream", """
    SELECT name, threshold, CAST(epoch(period_start) AS BIGINT) AS period_s, value, alarm FROM periods""",
       {"periods": PERIODS})
def t10(t: Tables):
    class Stream(Tables):
        def table(self, name: str):
            df = super().table(name)
            return T.read_stream(self.spark, self.sf_dir, df.schema, name=f"{name}.parquet")

    out = state(t, "alarms", T.PERIOD_DDL)
    T.alarm_stream(_alarm_metrics(Stream(t.spark, t.sf_dir)), out)
    return E.merge_periods(out.read(t.spark)).select(
        "name", "threshold", secs(F.col("period_start")).alias("period_s"), "value", "alarm")


@query("t10_live_event_log", f"""
    SELECT 'log' AS part, sk, event_type, ts_ms, message, NULL AS reason FROM ev WHERE ts_ms % 50 NOT IN (1, 2)
    UNION ALL SELECT 'alerts', sk, event_type, ts_ms, message, NULL FROM ev WHERE ts_ms % 50 NOT IN (1, 2)
    UNION ALL SELECT 'rejects', NULL, CASE WHEN ts_ms % 50 = 1 THEN event_type END, ts_ms, message,
      CASE ts_ms % 50 WHEN 1 THEN 'missing pipeline' ELSE 'missing type' END FROM ev WHERE ts_ms % 50 IN (1, 2)""", {"ev": EVENT_SQL})
def t10_log(t: Tables):
    """Job events into log, alerts and rejects; every fiftieth time has no pipeline, the one after it no type."""
    n = F.col("ts_ms") % 50
    damaged = _job_events(t).withColumns({
        "pipeline_id": F.when(n != 1, F.col("pipeline_id")), "event_type": F.when(n != 2, F.col("event_type"))})
    events = stream_of(t, "event_stream", lambda: damaged)
    log = G.EventLog(t.spark, work_dir(t.spark, "event-log"))
    G.event_log_stream(events, log, lambda: t.now)
    cols = ["part", "sk", "event_type", "ts_ms", "message", "reason"]
    parts = [log.read(t.spark, name).withColumn("part", F.lit(name)) for name in G.TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True).select(*cols)


@query("e4_live_threads", E4_SQL, {"evts": EVENTS})
def e4_live(t: Tables):
    """Alerts with their run's thread as they come."""
    alerts = stream_of(t, "alert_stream", lambda: E.alerts(_decision_events(t)).select(
        *RUN_KEY, "ts_ms", "event_type", "message"))
    out = state(t, "threaded", G.THREADED_DDL)
    G.thread_stream(alerts, G.thread_state(t.spark, work_dir(t.spark, "threads")), out)
    return out.read(t.spark).drop("thread_ms")
