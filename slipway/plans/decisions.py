"""SLA, reruns, retries, late data, baselines and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipway.functions import values as V, zones as Z
from slipway.operators import drift as D, reruns as N, rules as R, sla as L
from slipway.plans.registry import Tables, cents, query, secs
from slipway.plans.views import NOW, excluded, local, utc
from slipway.schema import RUN_KEY

KEYS = "pipeline_id, schedule_id, exec_date"
DAY = "CAST(substr(exec_date, 1, 10) AS TIMESTAMP)"


def deadline_sql(source: str, now: str, date: str = "exec_date") -> str:
    """Deadline columns for a source with exec date, sla_deadline, exp_s and sla_tz."""
    return f"""
        SELECT *, CASE WHEN derr IS NULL THEN due + to_seconds(roll) END AS breach,
          CASE WHEN derr IS NULL THEN due + to_seconds(roll - exp_s) END AS warning
        FROM (SELECT *, CASE WHEN sla_deadline LIKE ':%' THEN CASE WHEN length({date}) > 10 OR due < {now} THEN 3600
              ELSE 0 END WHEN due < {now} THEN 86400 ELSE 0 END AS roll,
            CASE WHEN exp_s IS NULL THEN 'bad_duration' WHEN sla_tz NOT IN (SELECT name FROM zones) THEN 'bad_timezone'
              END AS derr
          FROM (SELECT *, {utc("ldue", "ztz")} AS due FROM (
            SELECT *, CASE WHEN sla_deadline LIKE ':%'
                THEN lday + to_hours(CASE WHEN length({date}) > 10 THEN CAST(substr({date}, 12) AS INT)
                  ELSE CAST(hour({local(now, "ztz")}) AS INT) END) + to_minutes(CAST(substr(sla_deadline, 2) AS INT))
                ELSE lday + to_hours(CAST(substr(sla_deadline, 1, 2) AS INT)) END AS ldue
            FROM (SELECT *, CAST(substr({date}, 1, 10) AS TIMESTAMP) AS lday,
              CASE WHEN sla_tz IN (SELECT name FROM zones) THEN sla_tz ELSE 'UTC' END AS ztz FROM ({source})))))"""


RUN_SLA = f"""
    SELECT l.pipeline_id, l.schedule_id, l.exec_date, l.seq, l.event_ms, sla_deadline, exp_s, max_s, sla_tz,
      make_timestamp(l.event_ms * 1000) AS at_ts, {DAY} AS day_ts
    FROM latest l JOIN cfg c USING (pipeline_id) WHERE c.has_sla"""
DAILY_RUNS = f"""
    SELECT pipeline_id, schedule_id, day AS exec_date, sla_deadline, exp_s, sla_tz, CAST(day AS TIMESTAMP) AS day_ts
    FROM cfg, (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM slog) WHERE has_sla"""


def latest_runs(t: Tables):
    return L.latest_job_events(t.job_log).withColumn("at", F.timestamp_millis("event_ms"))


def run_day():
    return Z.midnight(V.valid_date(F.substring("exec_date", 1, 10)))


def hits(t: Tables):
    """Trigger hits of valid configs, marked where the wall clock excludes them, with schedule id and execution date."""
    return R.excluded_hits(R.trigger_hits(t.sensor_log, R.valid_configs(t.configs)))


def live_hits(t: Tables):
    """Hits that may start a run: excluded and observation-only ones take no lock and record no arrival."""
    return R.live_only(hits(t))


def arrivals(t: Tables):
    return t.stored("arrivals", lambda: L.first_arrivals(live_hits(t)))


def markers(t: Tables):
    return t.rerun_requests.filter(F.col("reason") == "").select("pipeline_id", "exec_date").distinct()


def _planned(t: Tables):
    return L.absolute_deadline(L.sla_runs(latest_runs(t), t.configs), now=run_day())


@query("l1_absolute_deadline", f"""
    SELECT {KEYS}, derr AS deadline_error, CAST(epoch(breach) AS BIGINT) AS breach_s,
      CAST(epoch(warning) AS BIGINT) AS warning_s FROM ({deadline_sql(RUN_SLA, "at_ts")})""")
def l1(t: Tables):
    d = L.absolute_deadline(L.sla_runs(latest_runs(t), t.configs), now=F.col("at"))
    return d.select(*RUN_KEY, "deadline_error", secs(F.col("breach_at")).alias("breach_s"),
                    secs(F.col("warning_at")).alias("warning_s"))


@query("l2_relative_deadline", f"""
    SELECT {KEYS}, CASE WHEN max_s IS NULL THEN 'bad_max_duration' END AS deadline_error,
      event_ms + max_s * 1000 AS breach_ms, event_ms + (max_s - coalesce(exp_s, max_s // 4)) * 1000 AS warning_ms
    FROM ({RUN_SLA})""")
def l2(t: Tables):
    d = L.relative_deadline(L.sla_runs(latest_runs(t), t.configs), arrival="at")
    return d.select(*RUN_KEY, "deadline_error", F.unix_millis("breach_at").alias("breach_ms"),
                    F.unix_millis("warning_at").alias("warning_ms"))


@query("l3_deadlines", f"""
    SELECT d.pipeline_id, d.schedule_id, d.exec_date, CASE WHEN max_s IS NOT NULL AND arrival_ms IS NOT NULL
        THEN 'relative' ELSE 'absolute' END AS deadline_kind,
      CASE WHEN max_s IS NOT NULL AND arrival_ms IS NOT NULL THEN arrival_ms // 1000 + max_s
        ELSE CAST(epoch(breach) AS BIGINT) END AS breach_s
    FROM ({deadline_sql(RUN_SLA, "at_ts")}) d LEFT JOIN arrivals a USING ({KEYS})""")
def l3(t: Tables):
    first = arrivals(t).select(*RUN_KEY, "arrival_at")
    d = L.deadlines(L.sla_runs(latest_runs(t), t.configs).join(first, RUN_KEY, "left"), now=F.col("at"))
    return d.select(*RUN_KEY, "deadline_kind", secs(F.col("breach_at")).alias("breach_s"))


@query("l4_reconcile", f"""
    SELECT {KEYS}, CASE WHEN breach IS NULL THEN NULL WHEN at_ts >= breach THEN 'SLA_BREACH'
      WHEN at_ts >= warning THEN 'SLA_WARNING' ELSE 'SLA_MET' END AS alert_type
    FROM ({deadline_sql(RUN_SLA, "day_ts")})""")
def l4(t: Tables):
    return L.reconcile(_planned(t), now=F.col("at")).select(*RUN_KEY, "alert_type")


TIMERS = f"""
    SELECT {KEYS}, pipeline_id || '-' || schedule_id || '-' || exec_date || '-sla-' || suffix AS name,
      CASE suffix WHEN 'warning' THEN 'SLA_WARNING' ELSE 'SLA_BREACH' END AS alert_type,
      CASE suffix WHEN 'warning' THEN warning ELSE breach END AS fire_at, breach
    FROM ({deadline_sql(DAILY_RUNS, "day_ts")}), (VALUES ('warning'), ('breach')) s(suffix) WHERE breach IS NOT NULL"""


def sensor_days(t: Tables):
    """Each day with sensor writes, one row per day for every row it is selected with; there are few days."""
    days = t.sensor_log.select(Z.day_text(F.col("ts")).alias("d")).distinct().agg(F.sort_array(F.collect_list("d")))
    return F.explode(days.scalar()).alias("exec_date")


def _daily_timers(t: Tables):
    runs = t.configs.select("pipeline_id", Z.schedule_id(F.col("cfg")).alias("schedule_id"), sensor_days(t))
    return L.timer_rows(L.absolute_deadline(L.sla_runs(runs, t.configs), now=run_day()))


@query("l5_due_timers", f"""
    SELECT {KEYS}, name, alert_type, CAST(epoch(fire_at) AS BIGINT) AS fire_s FROM ({TIMERS})
    WHERE fire_at <= TIMESTAMP '2024-01-20 12:00:00'""")
def l5(t: Tables):
    due = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return _daily_timers(t).filter(F.col("fire_at") <= due).select(
        *RUN_KEY, "name", "alert_type", secs(F.col("fire_at")).alias("fire_s"))


@query("l6_fire_alerts", f"""
    SELECT t.pipeline_id, t.schedule_id, t.exec_date, t.name, t.alert_type, coalesce(g.status, 'not started') AS status,
      CASE WHEN g.status = 'RUNNING' THEN 'pipeline running — may complete before breach'
        WHEN g.status IS NULL AND alert_type = 'SLA_BREACH' THEN 'pipeline not started — investigate trigger'
        ELSE 'pipeline not started — check sensor data' END AS action_hint
    FROM ({TIMERS}) t LEFT JOIN trig g USING ({KEYS})
    WHERE NOT (alert_type = 'SLA_WARNING' AND TIMESTAMP '2024-01-20 12:00:00' >= breach)
      AND NOT EXISTS (SELECT 1 FROM finished f WHERE f.pipeline_id = t.pipeline_id AND f.schedule_id = t.schedule_id
        AND f.exec_date = t.exec_date)""")
def l6(t: Tables):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return L.fire_alerts(_daily_timers(t), t.triggers, t.job_log, now=now).select(
        *RUN_KEY, "name", "alert_type", "status", "action_hint")


@query("l7_final_verdict", f"""
    SELECT {KEYS}, CASE WHEN breach IS NOT NULL AND at_ts >= breach THEN 'SLA_BREACH' ELSE 'SLA_MET' END AS verdict
    FROM ({deadline_sql(RUN_SLA, "day_ts")}) JOIN (SELECT {KEYS} FROM trig WHERE status <> 'RUNNING') USING ({KEYS})""")
def l7(t: Tables):
    done = t.triggers.filter(F.col("status") != "RUNNING")
    return L.final_verdicts(_planned(t), done, at=F.col("at")).select(*RUN_KEY, "verdict")


PLAN = f"""
    SELECT pipeline_id, schedule_id, sla_deadline, exp_s, sla_tz, {NOW} AS now_ts,
      CASE WHEN sla_deadline LIKE ':%' THEN '2024-01-30T20' ELSE '2024-01-30' END AS exec_date,
      CASE WHEN sla_deadline LIKE ':%' THEN '2024-01-30T20' WHEN cron IS NULL THEN '2024-01-31' ELSE '2024-01-30' END
        AS sla_date
    FROM cfg c WHERE has_sla AND NOT dry_run AND NOT {excluded(local(NOW, 'c.tz'))}"""


@query("l8_sla_plan", f"""
    SELECT {KEYS}, CAST(epoch(warning) AS BIGINT) AS warning_s, CAST(epoch(breach) AS BIGINT) AS breach_s
    FROM ({deadline_sql(PLAN, "now_ts", "sla_date")}) p WHERE breach > now_ts AND NOT EXISTS (
      SELECT 1 FROM finished f WHERE f.pipeline_id = p.pipeline_id AND f.schedule_id = p.schedule_id
        AND f.exec_date = p.exec_date)""")
def l8(t: Tables):
    return L.plan_alerts(t.configs, t.triggers, t.job_log, now=t.now).select(
        *RUN_KEY, secs(F.col("warning_at")).alias("warning_s"), secs(F.col("breach_at")).alias("breach_s"))


L9_SQL = f"""
    SELECT c.pipeline_id, c.schedule_id, a.exec_date, a.arrival_ms // 1000 + c.max_s AS breach_s
    FROM cfg c JOIN arrivals a USING (pipeline_id)
    WHERE NOT c.dry_run AND c.max_s IS NOT NULL AND a.exec_date IN ('2024-01-30', '2024-01-29')
      AND a.arrival_ms // 1000 + c.max_s <= epoch_us({NOW}) // 1000000
      AND NOT EXISTS (SELECT 1 FROM finished f WHERE f.pipeline_id = c.pipeline_id AND f.schedule_id = c.schedule_id
        AND f.exec_date = a.exec_date)
      AND (c.pipeline_id, a.exec_date) NOT IN (SELECT pipeline_id, exec_date FROM marks)"""


@query("l9_relative_breach", L9_SQL)
def l9(t: Tables):
    return L.relative_breaches(t.configs, arrivals(t), t.triggers, t.job_log, markers(t), now=t.now).select(
        *RUN_KEY, secs(F.col("breach_at")).alias("breach_s"))


ARRIVAL_SLA = """
    SELECT a.*, sla_deadline, exp_s, sla_tz, make_timestamp(arrival_ms * 1000) AS at_ts FROM arrivals a
    JOIN cfg c USING (pipeline_id) WHERE c.has_sla"""


@query("l10_projection", f"""
    SELECT {KEYS}, CASE WHEN exp_s IS NULL THEN 'n/a' WHEN breach IS NOT NULL
        AND at_ts + to_seconds(exp_s) > breach THEN 'breach' ELSE 'met' END AS sla_status,
      CAST(epoch_us(breach) // 1000 - epoch_us(at_ts) // 1000 - exp_s * 1000 AS BIGINT) AS margin_ms
    FROM ({deadline_sql(ARRIVAL_SLA, "at_ts")})""")
def l10(t: Tables):
    runs = L.sla_runs(arrivals(t), t.configs)
    return L.project(runs, at=F.timestamp_millis("arrival_ms")).select(
        *RUN_KEY, "sla_status", F.round(F.col("margin_s") * 1000).cast("bigint").alias("margin_ms"))


@query("l11_first_arrival", f"""
    SELECT {KEYS}, arrival_ms, seq FROM arrivals a WHERE NOT EXISTS (SELECT 1 FROM trig t WHERE
      t.pipeline_id = a.pipeline_id AND t.schedule_id = a.schedule_id AND t.exec_date = a.exec_date)""")
def l11(t: Tables):
    return L.first_arrivals(live_hits(t), t.triggers).select(*RUN_KEY, "arrival_ms", "seq")


@query("l12_terminal_runs", f"SELECT {KEYS}, event, event_ms FROM latest")
def l12(t: Tables):
    return L.terminal_runs(t.job_log)


# ---- reruns ----------------------------------------------------------------------------------------------

@query("n1_latest_job_event", f"SELECT {KEYS}, event_ms, seq, event, category, duration FROM latest")
def n1(t: Tables):
    return L.latest_job_events(t.job_log).select(*RUN_KEY, "event_ms", "seq", "event", "category", "duration")


@query("n2_freshness", f"""
    SELECT {KEYS}, event_ms, coalesce(max_upd > event_ms, TRUE) AS fresh
    FROM latest LEFT JOIN fresh USING (pipeline_id) WHERE event = 'success'""")
def n2(t: Tables):
    done = L.latest_job_events(t.job_log).filter(F.col("event") == "success")
    return N.freshness(done, t.sensors).select(*RUN_KEY, "event_ms", "fresh")


@query("n3_rerun_counts", f"""
    SELECT {KEYS}, count(*) AS n, count(*) FILTER (reason IN ('data-drift', 'late-data')) AS n_drift,
      count(*) FILTER (reason = 'job-fail-retry') AS n_retry, CAST(0 AS BIGINT) AS n_none FROM reruns GROUP BY ALL""")
def n3(t: Tables):
    return N.rerun_counts(t.reruns, {"n": None, "n_drift": N.DRIFT_REASONS, "n_retry": [N.RETRY_REASON], "n_none": []})


REQX = f"""
    SELECT q.*, j.event AS job_event, coalesce(j.event_ms, -1) AS job_ms,
      coalesce(j.event = 'success' AND NOT coalesce(f.max_upd > j.event_ms, TRUE), FALSE) AS unchanged,
      coalesce(p.n, 0) AS prior, coalesce(a.n, 0) AS prior_all, t.pipeline_id IS NOT NULL AS has_lock
    FROM (
      SELECT r.pipeline_id, r.schedule_id, r.exec_date, r.requested_ms, r.seq,
        CASE WHEN r.reason = '' THEN 'manual' ELSE r.reason END AS reason,
        CASE WHEN r.reason IN ('data-drift', 'late-data') THEN 'drift' ELSE 'manual' END AS class,
        CASE WHEN r.reason IN ('data-drift', 'late-data') THEN coalesce(c.max_drift, 1)
          ELSE coalesce(c.max_manual, 1) END AS budget,
        c.dry_run, {excluded("CAST(substr(r.exec_date, 1, 10) AS TIMESTAMP)")} AS excl
      FROM reqs r JOIN okcfg c USING (pipeline_id)) q
    ASOF LEFT JOIN jlog j ON q.pipeline_id = j.pipeline_id AND q.schedule_id = j.schedule_id
      AND q.exec_date = j.exec_date AND q.requested_ms >= j.event_ms
    LEFT JOIN fresh f ON f.pipeline_id = q.pipeline_id
    LEFT JOIN (SELECT {KEYS}, CASE WHEN reason IN ('data-drift', 'late-data') THEN 'drift' ELSE reason END AS class,
      count(*) AS n FROM reruns GROUP BY ALL) p ON p.pipeline_id = q.pipeline_id AND p.schedule_id = q.schedule_id
      AND p.exec_date = q.exec_date AND p.class = q.class
    LEFT JOIN (SELECT {KEYS}, count(*) AS n FROM reruns GROUP BY ALL) a ON a.pipeline_id = q.pipeline_id
      AND a.schedule_id = q.schedule_id AND a.exec_date = q.exec_date
    LEFT JOIN trig t ON t.pipeline_id = q.pipeline_id AND t.schedule_id = q.schedule_id AND t.exec_date = q.exec_date"""
ORDER = "ORDER BY requested_ms, reason, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
N4_SQL = f"""
    SELECT {KEYS}, requested_ms, seq, reason, decision, reject_reason, CASE WHEN decision = 'accepted' THEN prior_all
      + coalesce(sum(CAST(decision = 'accepted' AS INT)) OVER (PARTITION BY {KEYS} {ORDER}), 0) END AS attempt
    FROM (SELECT *, CASE WHEN excl THEN 'excluded' WHEN over OR breaker THEN 'rejected' WHEN NOT has_lock
        THEN 'infra_failure' ELSE 'accepted' END AS decision,
      CASE WHEN excl THEN 'excluded by calendar' WHEN over THEN class || ' rerun limit exceeded' WHEN breaker
        THEN 'previous run succeeded and no sensor data has changed' END AS reject_reason
    FROM (SELECT *, prior + CASE WHEN has_lock THEN least(passes, greatest(budget - prior, 0)) ELSE 0 END >= budget AS over
    FROM (SELECT *, coalesce(sum(CAST(NOT breaker AS INT)) OVER (PARTITION BY {KEYS}, class {ORDER}), 0) AS passes
    FROM (SELECT *, unchanged AND coalesce(sum(CAST(has_lock OR prior >= budget OR unchanged AS INT)) OVER (
        PARTITION BY {KEYS}, job_ms {ORDER}), 0) = 0 AS breaker FROM reqx WHERE NOT dry_run))))"""


@query("n4_rerun_decision", N4_SQL, {"reqx": REQX})
def n4(t: Tables):
    return N.rerun_decisions(t.rerun_requests, t.configs, t.reruns, t.job_log, t.triggers, t.sensors).select(
        *RUN_KEY, "requested_ms", "seq", "reason", "decision", "reject_reason", "attempt")


FAILX = f"""
    SELECT j.pipeline_id, j.schedule_id, j.exec_date, j.event_ms, j.seq, j.category, c.dry_run, coalesce(p.n, 0) AS prior,
      {excluded("CAST(substr(j.exec_date, 1, 10) AS TIMESTAMP)")} AS excl,
      CASE WHEN j.category = 'PERMANENT' THEN coalesce(c.max_code, 1) ELSE c.max_retries END AS lim,
      least(c.max_retries, coalesce(c.max_code, 1)) AS low, greatest(c.max_retries, coalesce(c.max_code, 1)) AS high
    FROM jlog j JOIN okcfg c USING (pipeline_id)
    LEFT JOIN (SELECT {KEYS}, count(*) AS n FROM reruns WHERE reason = 'job-fail-retry' GROUP BY ALL) p
      ON p.pipeline_id = j.pipeline_id AND p.schedule_id = j.schedule_id AND p.exec_date = j.exec_date
    WHERE j.event IN ('fail', 'timeout')"""
FORDER = "ORDER BY event_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
N5_SQL = f"""
    SELECT {KEYS}, event_ms, seq, lim AS max_retries, cnt AS rerun_count, CASE WHEN cnt >= lim THEN 'exhausted'
      WHEN excl THEN 'excluded' ELSE 'retry' END AS decision
    FROM (SELECT *, CASE WHEN excl THEN prior WHEN rk < free THEN prior + rk
        ELSE prior + free + least(big, greatest(high - prior - free, 0)) END AS cnt
    FROM (SELECT *, coalesce(sum(CAST(lim = high AND rk >= free AS INT)) OVER (PARTITION BY {KEYS} {FORDER}), 0) AS big
    FROM (SELECT *, greatest(low - prior, 0) AS free,
      row_number() OVER (PARTITION BY {KEYS} ORDER BY event_ms, seq) - 1 AS rk FROM failx WHERE NOT dry_run)))"""


@query("n5_retry_decision", N5_SQL, {"failx": FAILX})
def n5(t: Tables):
    return N.retry_decisions(t.job_log, t.configs, t.reruns, t.triggers).select(
        *RUN_KEY, "event_ms", "seq", "max_retries", "rerun_count", "decision")


N6_SQL = f"""
    SELECT h.pipeline_id, h.schedule_id, h.exec_date, h.ts_ms, h.seq, h.ts_ms - l.event_ms AS late_ms
    FROM hits h JOIN trig t USING ({KEYS}) JOIN latest l USING ({KEYS})
    WHERE NOT h.dry_run AND t.status = 'COMPLETED' AND l.event = 'success' AND h.ts_ms > l.event_ms
      AND NOT {excluded(local('h.ts', 'h.tz'), 'h')}
    QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY h.ts_ms, h.seq) = 1"""


@query("n6_late_data", N6_SQL)
def n6(t: Tables):
    return N.late_data(live_hits(t), t.triggers, t.job_log).select(*RUN_KEY, "ts_ms", "seq", "late_ms")


N7_SQL = """
    SELECT CASE event WHEN 'success' THEN 'completed' ELSE 'failure' END AS route,
      CASE event WHEN 'success' THEN 'JOB_COMPLETED' END AS event_type, pipeline_id, exec_date, seq FROM jlog"""


@query("n7_job_routing", N7_SQL)
def n7(t: Tables):
    return N.route_job_events(t.job_log).select("route", "event_type", "pipeline_id", "exec_date", "seq")


# ---- drift -----------------------------------------------------------------------------------------------

def captured(t: Tables):
    done = L.latest_job_events(t.job_log).filter(F.col("event") == "success")
    return D.capture_baselines(done, t.configs, t.sensor_log)


def baselines(t: Tables):
    return t.stored("baselines", lambda: captured(t))


def matched(t: Tables):
    return D.match_post_rules(t.sensor_log, R.valid_configs(t.configs))


@query("d1_baselines", f"""
    SELECT {KEYS}, rule_key, captured_ms, sensor_ms, sensor_seq, CAST(round(base_value * 100) AS BIGINT) AS cents
    FROM bl""")
def d1(t: Tables):
    return captured(t).select(*RUN_KEY, "rule_key", "captured_ms", "sensor_ms", "sensor_seq",
                               cents(V.number(V.field(F.col("baseline"), F.lit("count")))).alias("cents"))


@query("d2_drift", f"""
    SELECT {KEYS}, seq, CAST(round(base_value * 100) AS BIGINT) AS prev_cents, CAST(round(value * 100) AS BIGINT) AS cur_cents,
      abs(value - base_value) > drift_threshold AS drifted
    FROM postm JOIN bl USING ({KEYS}) WHERE NOT dry_run AND ts_ms > captured_ms""")
def d2(t: Tables):
    return D.with_baseline(matched(t), baselines(t), "inner").select(*RUN_KEY, "seq", cents(F.col("previous_count")).alias("prev_cents"),
                                     cents(F.col("current_count")).alias("cur_cents"), "drifted")


@query("d3_post_rule_match", f"""
    SELECT {KEYS}, seq, 'purchase' AS rule_key FROM postm WHERE NOT dry_run""")
def d3(t: Tables):
    return matched(t).select(*RUN_KEY, "seq", "rule_key")


@query("d4_post_run_route", f"""
    SELECT {KEYS}, seq, CASE trig.status WHEN 'RUNNING' THEN 'inflight' WHEN 'COMPLETED' THEN 'completed' ELSE 'ignore' END
      AS route FROM postm JOIN trig USING ({KEYS}) WHERE NOT dry_run""")
def d4(t: Tables):
    return D.route_post_run(matched(t), t.triggers).select(*RUN_KEY, "seq", "route")


@query("d5_inflight_drift", f"""
    SELECT {KEYS}, seq, CAST(round((value - base_value) * 100) AS BIGINT) AS delta_cents
    FROM postm JOIN trig USING ({KEYS}) JOIN bl USING ({KEYS})
    WHERE NOT dry_run AND trig.status = 'RUNNING' AND ts_ms > captured_ms
      AND abs(value - base_value) > drift_threshold""")
def d5(t: Tables):
    return D.inflight_drift(D.route_post_run(matched(t), t.triggers), baselines(t)).select(
        *RUN_KEY, "seq", cents(F.col("delta")).alias("delta_cents"))


COMPLETED = f"""
    SELECT {KEYS}, seq, ts_ms, value, coalesce(abs(value - base_value) > drift_threshold, FALSE) AS drifted,
      {excluded("CAST(substr(exec_date, 1, 10) AS TIMESTAMP)", "postm")} AS excl, sensor_key, u
    FROM postm JOIN trig USING ({KEYS}) LEFT JOIN bl USING ({KEYS})
    WHERE NOT dry_run AND trig.status = 'COMPLETED' AND (captured_ms IS NULL OR ts_ms > captured_ms)"""


def _completed(t: Tables):
    return D.completed_drift(D.route_post_run(matched(t), t.triggers), baselines(t))


@query("d6_completed_drift", f"""
    SELECT {KEYS}, seq, drifted, CASE WHEN drifted THEN CASE WHEN excl THEN 'PIPELINE_EXCLUDED' ELSE 'data-drift' END END
      AS follow_up FROM done""", {"done": COMPLETED})
def d6(t: Tables):
    return _completed(t).select(*RUN_KEY, "seq", "drifted", "follow_up")


FEEDBACK = {
    "done": COMPLETED, "late": N6_SQL, "reqx": REQX.replace("FROM reqs r", "FROM every_req r"),
    "every_req": f"""
        SELECT {KEYS}, requested_ms, seq, reason FROM reqs
        UNION ALL SELECT {KEYS}, ts_ms, seq, 'data-drift' FROM done WHERE drifted AND NOT excl
        UNION ALL SELECT {KEYS}, ts_ms, seq, 'late-data' FROM late"""}


def feedback_requests(t: Tables):
    """All rerun requests: those that were made, and those that drift and late data ask for."""
    drift = _completed(t).filter("follow_up = 'data-drift'").select(
        *RUN_KEY, F.col("ts_ms").alias("requested_ms"), "seq", F.col("follow_up").alias("reason"))
    late = N.late_data(live_hits(t), t.triggers, t.job_log).select(
        *RUN_KEY, F.col("ts_ms").alias("requested_ms"), "seq", F.lit("late-data").alias("reason"))
    return t.rerun_requests.select(*RUN_KEY, "requested_ms", "seq", "reason").unionByName(drift).unionByName(late)


@query("n8_feedback_decision", N4_SQL, FEEDBACK)
def n8(t: Tables):
    """Decisions over requests of all origins."""
    requests = t.stored("feedback_requests", lambda: feedback_requests(t))
    return N.rerun_decisions(requests, t.configs, t.reruns, t.job_log, t.triggers, t.sensors).select(
        *RUN_KEY, "requested_ms", "seq", "reason", "decision", "reject_reason", "attempt")


@query("n8_baselines_left", f"""
    SELECT {KEYS}, captured_ms FROM bl b WHERE NOT EXISTS (SELECT 1 FROM ({N4_SQL}) d WHERE d.pipeline_id = b.pipeline_id
      AND d.schedule_id = b.schedule_id AND d.exec_date = b.exec_date AND d.decision = 'accepted'
      AND d.requested_ms > b.captured_ms)""", FEEDBACK)
def n8_baselines(t: Tables):
    """Baselines that no accepted rerun has removed since they were captured."""
    accepted = n8(t).filter("decision = 'accepted'").groupBy(*RUN_KEY).agg(F.max("requested_ms").alias("last"))
    return D.keep_baselines(baselines(t), accepted).select(*RUN_KEY, "captured_ms")


@query("d7_post_run_rules", f"""
    SELECT {KEYS}, seq, CASE WHEN u % 3 <> 1 AND EXISTS (SELECT 1 FROM sens s WHERE s.pipeline_id = d.pipeline_id
      AND s.value > 0 AND s.sensor_key IN ('purchase', 'purchase#' || d.exec_date,
        'purchase#' || replace(d.exec_date, '-', ''))) THEN 'POST_RUN_PASSED' ELSE 'POST_RUN_FAILED' END AS event_type
    FROM done d WHERE NOT drifted""", {"done": COMPLETED})
def d7(t: Tables):
    return D.post_run_results(_completed(t), t.configs, t.sensors, now=t.now).select(*RUN_KEY, "seq", "event_type")


D8_SQL = f"""
    SELECT c.pipeline_id, c.schedule_id, l.exec_date, l.event_ms AS completed_ms FROM cfg c
    JOIN latest l ON l.pipeline_id = c.pipeline_id AND l.schedule_id = c.schedule_id
    JOIN trig t ON t.pipeline_id = c.pipeline_id AND t.schedule_id = c.schedule_id AND t.exec_date = l.exec_date
    WHERE c.has_post AND NOT c.dry_run AND l.exec_date = '2024-01-30' AND l.event = 'success' AND t.status = 'COMPLETED'
      AND epoch_us({NOW}) // 1000 >= l.event_ms + CASE c.sensor_timeout WHEN '90m' THEN 5400000 ELSE 7200000 END
      AND (c.pipeline_id, l.exec_date) IN (SELECT pipeline_id, exec_date FROM bl)
      AND (c.pipeline_id, l.exec_date) NOT IN (SELECT pipeline_id, exec_date FROM marks)
      AND NOT EXISTS (SELECT 1 FROM sens s WHERE s.pipeline_id = c.pipeline_id AND s.sensor_key = 'purchase'
        AND s.upd_raw > l.event_ms)"""


@query("d8_missing_post_sensor", D8_SQL)
def d8(t: Tables):
    return D.missing_post_sensors(t.configs, t.triggers, t.job_log, t.sensors, baselines(t), markers(t), now=t.now).select(
        *RUN_KEY, "completed_ms")
