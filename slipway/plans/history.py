"""Run states and replay, observation, absence checks, events and accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipway.functions import values as V
from slipway.functions.ordered import earliest_by
from slipway.operators import accounting as Q, events as E, observe as O, reruns as N, rules as R, runs as J
from slipway.operators import sla as L, watchdog as W
from slipway.plans.decisions import (
    D8_SQL, FAILX, KEYS, L9_SQL, PLAN, REQX, arrivals, baselines, deadline_sql, hits, live_hits, markers)
from slipway.plans.base import LAST_FIRE
from slipway.plans.registry import Tables, cents, query, secs
from slipway.plans.views import NOW, excluded, local, utc
from slipway.schema import RUN_KEY
from slipway.session import staged, work_dir
from slipway.sources import control as S

# ---- run states and logs ---------------------------------------------------------------------------------

STATES = """
    SELECT *, CASE WHEN job_type IN ('command', 'http', 'lambda') THEN 'running'
        WHEN state IN ('SUCCEEDED', 'COMPLETED', 'SUCCESS', 'success') OR result_state = 'SUCCESS' THEN 'succeeded'
        WHEN state IN ('FAILED', 'CANCELLED', 'TIMED_OUT', 'SKIPPED', 'failed', 'TERMINATED', 'INTERNAL_ERROR') THEN 'failed'
        ELSE 'running' END AS run_state,
      CASE WHEN result_state = 'SUCCESS' OR job_type IN ('command', 'http', 'lambda', 'airflow') THEN NULL
        WHEN state IN ('FAILED', 'CANCELLED', 'TERMINATED', 'INTERNAL_ERROR') THEN 'TRANSIENT'
        WHEN state = 'TIMED_OUT' THEN 'TIMEOUT' WHEN state = 'SKIPPED' THEN 'PERMANENT' END AS failure_category,
      state || coalesce('/' || result_state, '') AS state_message
    FROM (SELECT *, CASE WHEN job_type = 'databricks' AND state = 'TERMINATED'
        THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'FAILED' ELSE 'SUCCESS' END END AS result_state
    FROM (SELECT o_orderkey AS run_id, job_type, o_orderpriority, CASE job_type
        WHEN 'glue' THEN ['SUCCEEDED', 'FAILED', 'RUNNING'][i] WHEN 'emr' THEN ['COMPLETED', 'CANCELLED', 'PENDING'][i]
        WHEN 'emr-serverless' THEN ['SUCCESS', 'FAILED', 'SUBMITTED'][i]
        WHEN 'step-function' THEN ['SUCCEEDED', 'TIMED_OUT', 'RUNNING'][i]
        WHEN 'databricks' THEN ['TERMINATED', 'SKIPPED', 'INTERNAL_ERROR'][i]
        WHEN 'airflow' THEN ['success', 'failed', 'queued'][i] ELSE 'RUNNING' END AS state
    FROM (SELECT *, ['command', 'http', 'airflow', 'glue', 'emr', 'emr-serverless', 'step-function', 'databricks',
        'lambda'][o_orderkey % 9 + 1] AS job_type,
      CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS i FROM orders)))"""


@query("j1_run_states", "SELECT run_id, job_type, run_state, failure_category, state_message FROM states",
       {"states": STATES})
def j1(t: Tables):
    return J.normalise_states(t.run_states).select("run_id", "job_type", "run_state", "failure_category", "state_message")


LOGS = """
    SELECT doc_id, line_no - 1 AS line_no, line, length(line) AS n FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"""
J2_SQL = """
    SELECT s.run_id, s.job_type, CASE WHEN lie THEN 'failed' ELSE run_state END AS run_state,
      CASE WHEN lie THEN 'TRANSIENT' ELSE failure_category END AS failure_category,
      CASE WHEN lie THEN 'SUCCEEDED (' || why || ')' ELSE state_message END AS state_message
    FROM (SELECT s.*, why, job_type = 'glue' AND run_state = 'succeeded' AND why IS NOT NULL AS lie
      FROM states s LEFT JOIN (
        SELECT doc_id, CASE WHEN bool_or(n % 211 = 11) THEN 'RCA: ' || arg_min(replace(substr(line, 1, 20), '"', ''),
            line_no) FILTER (n % 211 = 11)
          ELSE 'driver log: ' || arg_min(substr(msg, 1, list_max(list_filter(range(0, 201), lambda k: strlen(substr(msg, 1, k)) <= 200))),
            line_no)
            FILTER (n % 211 <> 11 AND (n % 97 = 5 OR n % 89 = 7)) END AS why
        FROM (SELECT *, CASE WHEN n % 97 = 5 THEN '24/01/30 ERROR Task - ' ELSE '24/01/30 FATAL Main - ' END || line AS msg
          FROM logs) WHERE n % 211 = 11 OR n % 97 = 5 OR n % 89 = 7 GROUP BY doc_id) l ON l.doc_id = s.run_id) s"""


@query("j2_false_success", J2_SQL, {"states": STATES, "logs": LOGS})
def j2(t: Tables):
    return J.false_successes(J.normalise_states(t.run_states), t.run_logs).select(
        "run_id", "job_type", "run_state", "failure_category", "state_message")


@query("j3_classify", """
    SELECT pipeline_id, seq, CASE WHEN error LIKE '%status 4%' THEN 'PERMANENT' WHEN error IS NOT NULL THEN 'TRANSIENT'
      END AS failure_category FROM jlog""")
def j3(t: Tables):
    return J.classify_failures(t.job_log).select("pipeline_id", "seq", "failure_category")


def _poll_outcomes(t: Tables):
    masked = t.job_log.withColumn("event", F.when(F.col("event") == "timeout", "infra-trigger-failure").otherwise(
        F.col("event")))
    latest = L.latest_job_events(masked).drop("category")
    states = J.normalise_states(t.run_states).withColumn("run_id", F.concat(F.lit("r"), F.col("run_id").cast("string")))
    polled = latest.select(*RUN_KEY, "run_id").join(states, "run_id")
    return J.poll_outcomes(latest, polled)


@query("j4_poll_outcome", f"""
    SELECT l.pipeline_id, l.schedule_id, l.exec_date, CASE WHEN event <> 'timeout' THEN event
        WHEN run_state = 'succeeded' THEN 'success' WHEN run_state = 'failed' THEN 'fail' END AS outcome,
      event = 'timeout' AND run_state <> 'running' AS write_event,
      CASE WHEN event = 'timeout' AND run_state = 'failed' THEN s.failure_category END AS category
    FROM latest l JOIN states s ON l.seq = s.run_id""", {"states": STATES})
def j4(t: Tables):
    return _poll_outcomes(t).select(*RUN_KEY, "outcome", "write_event", "category")


@query("j5_completion", f"""
    SELECT t.pipeline_id, t.schedule_id, t.exec_date, CASE WHEN o IS NULL THEN t.status WHEN o = 'success' THEN 'COMPLETED'
      ELSE 'FAILED_FINAL' END AS status, CASE WHEN o IS NULL THEN ttl_epoch END AS ttl_epoch
    FROM trig t JOIN (SELECT {KEYS}, CASE WHEN event <> 'timeout' THEN event WHEN run_state = 'succeeded' THEN 'success'
      WHEN run_state = 'failed' THEN 'fail' END AS o FROM latest l JOIN states s ON l.seq = s.run_id) USING ({KEYS})""",
       {"states": STATES})
def j5(t: Tables):
    moves = J.completion_transitions(_poll_outcomes(t)).withColumn("at", F.lit(0).cast("bigint"))
    return S.apply_transitions(t.triggers, moves)


STARTS = f"""
    SELECT pipeline_id, schedule_id, exec_date, ts_ms AS start_ms FROM hits h
    WHERE NOT dry_run AND NOT {excluded(local('h.ts', 'h.tz'), 'h')}
    QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY ts_ms, seq) = 1"""


def starts(t: Tables):
    return t.stored("run_starts", lambda: earliest_by(live_hits(t), RUN_KEY, ["ts_ms", "seq"], []).select(
        *RUN_KEY, F.col("ts_ms").alias("start_ms")))


def ticks_sql(source: str) -> str:
    """Rule verdict per (run, tick_ms) of a source with run key and tick_ms."""
    return f"""
        SELECT {KEYS}, tick_ms, mode, CASE WHEN upper(mode) = 'ANY' THEN n_passed > 0 ELSE n_passed = n_rules END AS passed,
          n_rules
        FROM (SELECT k.pipeline_id, k.schedule_id, k.exec_date, k.tick_ms, c.mode, count(r.pos) AS n_rules,
          count(r.pos) FILTER (CASE r.chk WHEN 'exists' THEN v IS NOT NULL WHEN 'equals' THEN v.status = 'ready'
            WHEN 'gte' THEN v.value >= r.num WHEN 'lt' THEN v.value < r.num
            WHEN 'age_lt' THEN k.tick_ms - epoch_us(v.seen_at) // 1000 < 86400000 ELSE FALSE END) AS n_passed
        FROM (SELECT DISTINCT {KEYS}, tick_ms FROM ({source})) k JOIN cfg c USING (pipeline_id)
        LEFT JOIN rules r USING (pipeline_id)
        LEFT JOIN LATERAL (SELECT arg_max(struct_pack(status := s.status, value := s.value, seen_at := s.seen_at),
            (CASE WHEN s.sensor_key = r.key THEN 0 WHEN contains(s.sensor_key, '-') THEN 2 ELSE 1 END, s.ts_ms, s.seq)) AS v
          FROM slog s WHERE s.pipeline_id = k.pipeline_id AND s.ts_ms <= k.tick_ms AND s.sensor_key IN (r.key,
            r.key || '#' || k.exec_date, r.key || '#' || replace(k.exec_date, '-', ''))) ON TRUE
        GROUP BY ALL)"""


TICKS = f"""
    SELECT {KEYS}, start_ms, n_ticks, tick, start_ms + tick * eval_interval * 1000 AS tick_ms
    FROM (SELECT s.*, eval_interval, greatest(1, CAST(ceil(eval_window / eval_interval) AS BIGINT)) AS n_ticks
      FROM starts s JOIN cfg USING (pipeline_id)), LATERAL (SELECT unnest(range(0, n_ticks)) AS tick)"""
REPLAY = f"""
    SELECT {KEYS}, start_ms, n_ticks, min(tick) FILTER (passed) AS tick, min(tick_ms) FILTER (passed) AS passed_ms
    FROM ticks JOIN ticked USING ({KEYS}, tick_ms) GROUP BY ALL"""
REPLAY_VIEWS = {"starts": STARTS, "ticks": TICKS, "ticked": ticks_sql("SELECT * FROM ticks"), "replay": REPLAY}


@query("j7_readiness_replay", f"""
    SELECT {KEYS}, start_ms, n_ticks, tick, passed_ms, CASE WHEN tick IS NULL THEN 'exhausted' ELSE 'passed' END AS status,
      coalesce(tick + 1, n_ticks) AS evaluations FROM replay""", REPLAY_VIEWS)
def j7(t: Tables):
    return J.readiness_replay(starts(t), t.configs, t.sensor_log).drop("event_type")


POLL_STARTS = f"SELECT {KEYS}, event_ms - 1800000 - (seq % 5) * 1000000 AS base_ms FROM latest"


@query("j8_poll_replay", f"""
    SELECT {KEYS}, coalesce(poll, n_polls) AS polls, coalesce(event, 'timeout') AS outcome, event IS NULL AS poll_exhausted,
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
      GROUP BY ALL)""", {"base": POLL_STARTS})
def j8(t: Tables):
    runs = L.latest_job_events(t.job_log).select(
        *RUN_KEY, (F.col("event_ms") - 1_800_000 - F.col("seq") % 5 * 1_000_000).alias("passed_ms"))
    return J.poll_replay(runs, t.configs, t.job_log).drop("event_type")


RUN_POLL = f"""
    SELECT b.pipeline_id, b.schedule_id, b.exec_date, b.n_polls, b.passed_ms, min(k) AS poll, arg_min(x.event, k) AS event
    FROM (SELECT s.*, CASE WHEN c.poll_window > 0 THEN CAST(ceil(c.poll_window / 60) AS BIGINT) ELSE 60 END AS n_polls
      FROM replay s JOIN cfg c USING (pipeline_id) WHERE passed_ms IS NOT NULL) b
    LEFT JOIN (SELECT s.pipeline_id, s.schedule_id, s.exec_date, j.event, greatest(1,
        CAST(ceil((j.event_ms - s.passed_ms) / 60000) AS BIGINT)) AS k
      FROM replay s JOIN jlog j USING ({KEYS}) WHERE s.passed_ms IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY s.pipeline_id, s.schedule_id, s.exec_date, k
        ORDER BY j.event_ms DESC, j.seq DESC) = 1) x
      ON x.pipeline_id = b.pipeline_id AND x.schedule_id = b.schedule_id AND x.exec_date = b.exec_date AND k <= b.n_polls
    GROUP BY ALL"""
J9_BASE = f"""
    SELECT r.pipeline_id, r.schedule_id, r.exec_date, r.start_ms, r.passed_ms, p.n_polls, p.poll, p.event,
      sla_deadline, exp_s, sla_tz, has_sla, make_timestamp(r.start_ms * 1000) AS at_ts,
      r.passed_ms + coalesce(poll, n_polls) * 60000 AS finished_ms,
      CASE WHEN r.passed_ms IS NOT NULL THEN coalesce(event, 'timeout') END AS outcome
    FROM replay r LEFT JOIN polls p USING ({KEYS}) JOIN cfg c ON c.pipeline_id = r.pipeline_id"""


@query("j6_exhaustion", f"""
    SELECT {KEYS}, 'validation-exhausted' AS event, 'VALIDATION_EXHAUSTED' AS event_type, start_ms AS event_ms,
      FALSE AS release_lock FROM replay WHERE passed_ms IS NULL
    UNION ALL SELECT {KEYS}, 'job-poll-exhausted', 'JOB_POLL_EXHAUSTED', passed_ms + n_polls * 60000, FALSE
      FROM polls WHERE event IS NULL
    UNION ALL SELECT {KEYS}, 'infra-trigger-exhausted', 'RETRY_EXHAUSTED', event_ms, TRUE FROM jlog
      WHERE error LIKE '%status 503'""", {**REPLAY_VIEWS, "polls": RUN_POLL})
def j6(t: Tables):
    ready = staged(J.readiness_replay(starts(t), t.configs, t.sensor_log), "readiness")
    polled = J.poll_replay(ready.filter(F.col("status") == "passed"), t.configs, t.job_log)
    failed = t.job_log.filter(F.col("error").endswith("status 503")).withColumnRenamed("event_ms", "at_ms")
    return J.exhaustion_rows(ready, polled, failed).select(*RUN_KEY, "event", "event_type", "event_ms", "release_lock")


@query("j9_run_outcome", f"""
    SELECT {KEYS}, start_ms, CASE WHEN passed_ms IS NULL THEN 'exhausted' ELSE 'passed' END AS validation, passed_ms, outcome,
      finished_ms, CASE WHEN outcome IS NULL THEN 'RUNNING' WHEN outcome = 'success' THEN 'COMPLETED' ELSE 'FAILED_FINAL' END
        AS final_status,
      CASE WHEN has_sla AND finished_ms IS NOT NULL AND breach IS NOT NULL THEN CASE WHEN make_timestamp(finished_ms * 1000)
        >= breach THEN 'SLA_BREACH' ELSE 'SLA_MET' END END AS sla_verdict
    FROM ({deadline_sql("SELECT * FROM j9b", "at_ts")})""", {**REPLAY_VIEWS, "polls": RUN_POLL, "j9b": J9_BASE})
def j9(t: Tables):
    return J.run_outcomes(starts(t), t.configs, t.sensor_log, t.job_log).drop("poll_exhausted", "polls")


# ---- observation -----------------------------------------------------------------------------------------

def dry_hits(t: Tables):
    return hits(t).filter(~F.col("excluded") & F.col("cfg.dryRun"))


DRY = f"""
    SELECT pipeline_id, schedule_id, exec_date, ts_ms AS tick_ms, ts_ms, seq FROM hits h
    WHERE dry_run AND NOT {excluded(local('h.ts', 'h.tz'), 'h')}"""
MARKS = f"""
    SELECT {KEYS}, tick_ms AS triggered_ms, seq, n_rules FROM dry JOIN ticked USING ({KEYS}, tick_ms) WHERE passed
    QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY tick_ms, seq) = 1"""
OBSERVED = {"dry": DRY, "ticked": ticks_sql("SELECT * FROM dry"), "omarks": MARKS}


def first_observed(t: Tables):
    return O.would_trigger(t.stored("dry_hits", lambda: dry_hits(t).select(*RUN_KEY, "ts_ms", "seq")), t.configs,
                           t.sensor_log)


def dry_markers(t: Tables):
    return t.stored("dry_markers", lambda: first_observed(t))


@query("o1_would_trigger", f"SELECT {KEYS}, triggered_ms, seq, n_rules FROM omarks", OBSERVED)
def o1(t: Tables):
    return first_observed(t).select(*RUN_KEY, "triggered_ms", "seq", F.col("n_rules").cast("bigint").alias("n_rules"))


@query("o2_late_data", f"""
    SELECT {KEYS}, d.ts_ms, d.seq, d.ts_ms - triggered_ms AS late_ms FROM dry d JOIN omarks m USING ({KEYS})
    WHERE (d.ts_ms, d.seq) > (m.triggered_ms, m.seq)""", OBSERVED)
def o2(t: Tables):
    return O.late_data(dry_hits(t), dry_markers(t)).select(*RUN_KEY, "ts_ms", "seq", "late_ms")


O3_BASE = """
    SELECT m.*, sla_deadline, exp_s, sla_tz, make_timestamp(triggered_ms * 1000) AS at_ts FROM omarks m
    JOIN cfg USING (pipeline_id)"""


@query("o3_completed", f"""
    SELECT {KEYS}, triggered_ms, CASE WHEN exp_s IS NULL THEN 'n/a' WHEN breach IS NOT NULL
      AND at_ts + to_seconds(exp_s) > breach THEN 'breach' ELSE 'met' END AS sla_status
    FROM ({deadline_sql("SELECT * FROM o3b", "at_ts")})""", {**OBSERVED, "o3b": O3_BASE})
def o3(t: Tables):
    return O.completed_summary(dry_markers(t), t.configs).select(*RUN_KEY, "triggered_ms", "sla_status")


@query("o4_would_drift", f"""
    SELECT {KEYS}, p.seq, CAST(round((p.value - b.value) * 100) AS BIGINT) AS delta_cents
    FROM postm p JOIN (
      SELECT m.pipeline_id, m.schedule_id, m.exec_date, m.triggered_ms, s.value FROM omarks m JOIN slog s
        ON s.pipeline_id = m.pipeline_id AND s.event_type = 'purchase' AND s.ts_ms <= m.triggered_ms AND s.sensor_key IN
          ('purchase', 'purchase#' || m.exec_date, 'purchase#' || replace(m.exec_date, '-', ''))
      QUALIFY row_number() OVER (PARTITION BY m.pipeline_id, m.schedule_id, m.exec_date ORDER BY s.ts_ms DESC, s.seq DESC)
        = 1) b USING ({KEYS})
    WHERE p.dry_run AND p.ts_ms > b.triggered_ms AND abs(p.value - b.value) > p.drift_threshold""", OBSERVED)
def o4(t: Tables):
    return O.would_drift(t.sensor_log, dry_markers(t), R.valid_configs(t.configs)).select(
        *RUN_KEY, "seq", cents(F.col("delta")).alias("delta_cents"))


@query("o5_would_rerun", f"""
    SELECT {KEYS}, requested_ms, seq, reason, CASE WHEN excl OR prior >= budget OR unchanged
        THEN 'DRY_RUN_RERUN_REJECTED' ELSE 'DRY_RUN_WOULD_RERUN' END AS event_type,
      CASE WHEN excl THEN 'excluded by calendar' WHEN prior >= budget THEN 'limit exceeded' WHEN unchanged
        THEN 'circuit breaker' END AS reject_reason,
      CASE WHEN excl OR prior >= budget THEN NULL WHEN job_event IS NULL THEN 'skipped (no job history)'
        WHEN unchanged THEN 'rejected' ELSE 'passed' END AS circuit_breaker
    FROM reqx WHERE dry_run""", {"reqx": REQX})
def o5(t: Tables):
    return N.observed_rerun_decisions(t.rerun_requests, t.configs, t.reruns, t.job_log, t.sensors).drop(
        "rerun_count", "budget")


@query("o6_would_retry", f"""
    SELECT {KEYS}, event_ms, seq, prior AS retries, lim AS max_retries, CASE WHEN prior >= lim OR excl
      THEN 'DRY_RUN_RETRY_EXHAUSTED' ELSE 'DRY_RUN_WOULD_RETRY' END AS event_type FROM failx WHERE dry_run""",
       {"failx": FAILX})
def o6(t: Tables):
    return N.observed_retry_decisions(t.job_log, t.configs, t.reruns).drop("reason")


# ---- absence checks --------------------------------------------------------------------------------------

W1_SQL = f"""
    SELECT {KEYS}, ttl_epoch FROM trig t WHERE status = 'RUNNING' AND ttl_epoch < epoch_us({NOW}) // 1000000
      AND NOT EXISTS (SELECT 1 FROM cfg c WHERE c.pipeline_id = t.pipeline_id AND c.dry_run)"""


@query("w1_stale_runs", W1_SQL)
def w1(t: Tables):
    return W.stale_runs(t.triggers, t.configs, now=t.now).select(*RUN_KEY, "ttl_epoch")


LIVE = f"NOT c.dry_run AND NOT {excluded(local(NOW, 'c.tz'))}"
NO_TRIGGER_TODAY = """NOT EXISTS (SELECT 1 FROM trig t WHERE t.pipeline_id = c.pipeline_id
    AND t.schedule_id = c.schedule_id AND starts_with(t.exec_date, '2024-01-30'))"""
STARTED = f"coalesce({local(NOW, 'c.tz')} >= CAST('2024-01-30 ' || c.sched_time || ':00' AS TIMESTAMP), TRUE)"
W2_ALL = f"""
    SELECT c.pipeline_id, c.schedule_id, '2024-01-30' AS exec_date, c.cron FROM cfg c JOIN lf USING (pipeline_id)
    WHERE c.cron IS NOT NULL AND {LIVE} AND {STARTED} AND {NO_TRIGGER_TODAY}"""
W2_SQL = f"""{W2_ALL}
      AND coalesce(timezone('UTC', timezone(lf.tz, fire_local)) >= TIMESTAMP '2024-01-30 05:00:00', TRUE)"""


@query("w2_missed_cron", W2_SQL, {"lf": LAST_FIRE})
def w2(t: Tables):
    deployed = F.lit("2024-01-30 05:00:00").cast("timestamp")
    return W.missed_schedules(t.configs, t.triggers, now=t.now, deployed_at=deployed).select(*RUN_KEY, "cron")


W3_SQL = f"""
    SELECT DISTINCT c.pipeline_id, c.schedule_id, d AS exec_date FROM cfg c JOIN (
      SELECT pipeline_id, d FROM (SELECT pipeline_id, unnest(include_dates) AS d FROM cfg)
      WHERE d LIKE '2%-%' AND d <= '2024-01-30' QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY d DESC) <= 3
    ) USING (pipeline_id)
    WHERE {LIVE} AND NOT EXISTS (SELECT 1 FROM trig t WHERE t.pipeline_id = c.pipeline_id
        AND t.schedule_id = c.schedule_id AND starts_with(t.exec_date, d))
      AND (c.pipeline_id, d) NOT IN (SELECT pipeline_id, exec_date FROM marks)"""


@query("w3_missed_inclusion", W3_SQL)
def w3(t: Tables):
    return W.missed_inclusions(t.configs, t.triggers, markers(t), now=t.now).select(*RUN_KEY)


W4_SQL = f"""
    SELECT c.pipeline_id, c.schedule_id, s.exec_date, min(s.sensor_key) AS sensor_key FROM sens s JOIN cfg c USING (pipeline_id)
    WHERE c.has_trigger AND c.cron IS NULL AND {LIVE} AND s.event_type = 'click' AND s.value > 1
      AND NOT EXISTS (SELECT 1 FROM trig t WHERE t.pipeline_id = c.pipeline_id AND t.schedule_id = c.schedule_id
        AND starts_with(t.exec_date, s.exec_date))
    GROUP BY ALL"""


@query("w4_recovered", W4_SQL)
def w4(t: Tables):
    return W.recover_triggers(t.configs, t.sensors, t.triggers, t.job_log, now=t.now).select(*RUN_KEY, "sensor_key")


W5_BASE = f"""
    SELECT c.pipeline_id, c.schedule_id, trig_deadline,
      CASE WHEN trig_deadline LIKE ':%' THEN '2024-01-30T20' ELSE '2024-01-30' END AS exec_date,
      CASE WHEN tz_raw IS NOT NULL THEN tz ELSE CASE WHEN sla_tz IN (SELECT name FROM zones) THEN sla_tz ELSE 'UTC' END END
        AS wtz,
      CASE trig_deadline WHEN ':30' THEN TIMESTAMP '2024-01-30 21:30:00' WHEN '09:00' THEN TIMESTAMP '2024-01-30 09:00:00'
        END AS closes
    FROM cfg c WHERE trig_deadline IS NOT NULL AND {LIVE}"""
W5_SQL = f"""
    SELECT {KEYS}, trig_deadline AS trigger_deadline, CAST(epoch({utc('closes', 'wtz')}) AS BIGINT) AS closed_s
    FROM w5b w WHERE {utc('closes', 'wtz')} <= {NOW}
      AND NOT EXISTS (SELECT 1 FROM {{known}} t WHERE t.pipeline_id = w.pipeline_id AND t.schedule_id = w.schedule_id
        AND t.exec_date = w.exec_date)"""


@query("w5_window_expired", W5_SQL.format(known="trig"), {"w5b": W5_BASE})
def w5(t: Tables):
    return W.expired_windows(t.configs, t.triggers, t.job_log, now=t.now).select(
        *RUN_KEY, "trigger_deadline", secs(F.col("closed_at")).alias("closed_s"))


def _findings(t: Tables):
    m = markers(t)
    marks = None
    for check in ("missed_inclusion", "post_run_missing", "relative_breach"):
        part = m.withColumn("check", F.lit(check))
        marks = part if marks is None else marks.unionByName(part)
    return W.all_findings(t.configs, t.sensors, t.triggers, t.job_log, baselines(t), arrivals(t), marks,
                          now=t.now)


@query("w6_watchdog", f"""
    SELECT 'stale' AS check, {KEYS}, 'SFN_TIMEOUT' AS event_type FROM ({W1_SQL})
    UNION ALL SELECT 'missed_schedule', {KEYS}, 'SCHEDULE_MISSED' FROM ({W2_ALL})
    UNION ALL SELECT 'missed_inclusion', {KEYS}, 'IRREGULAR_SCHEDULE_MISSED' FROM ({W3_SQL})
    UNION ALL SELECT 'recovered', {KEYS}, 'TRIGGER_RECOVERED' FROM w4r
    UNION ALL SELECT 'sla_plan', {KEYS}, NULL FROM ({deadline_sql(PLAN, "now_ts", "sla_date")}) p
      WHERE breach > now_ts AND NOT EXISTS (SELECT 1 FROM staled f WHERE f.pipeline_id = p.pipeline_id
        AND f.schedule_id = p.schedule_id AND f.exec_date = p.exec_date)
    UNION ALL SELECT 'window_expired', {KEYS}, 'SENSOR_DEADLINE_EXPIRED' FROM ({W5_SQL.format(known="known")})
    UNION ALL SELECT 'post_run_missing', {KEYS}, 'POST_RUN_SENSOR_MISSING' FROM ({D8_SQL})
    UNION ALL SELECT 'relative_breach', {KEYS}, 'RELATIVE_SLA_BREACH' FROM ({L9_SQL.replace("finished", "failed_too")})""",
       {"lf": LAST_FIRE, "w5b": W5_BASE, "w4r": W4_SQL,
        "known": f"SELECT {KEYS} FROM trig UNION ALL SELECT {KEYS} FROM w4r",
        "staled": f"SELECT {KEYS} FROM finished UNION SELECT {KEYS} FROM ({W1_SQL})",
        "failed_too": f"SELECT {KEYS} FROM staled UNION SELECT {KEYS} FROM ({W5_SQL.format(known='known')})"})
def w6(t: Tables):
    return W.run_checks(_findings(t), work_dir(t.spark, "findings"))[0]


# ---- events ----------------------------------------------------------------------------------------------

def _decision_events(t: Tables):
    """Events of three decision tables: late data, stale runs and routed job events."""
    late = N.late_data(live_hits(t), t.triggers, t.job_log)
    stale = W.stale_runs(t.triggers, t.configs, now=t.now)
    jobs = J.classify_failures(N.route_job_events(t.job_log), out="failure")
    jobs = jobs.withColumn("event_type", F.coalesce("event_type", F.when(F.col("event") == "fail", "JOB_FAILED").otherwise(
        "JOB_POLL_EXHAUSTED")))
    failed = F.col("event") != "success"
    return E.union_events(
        E.build_events(late, ts_ms=F.col("ts_ms"), message=F.concat(F.lit("late data for "), "pipeline_id")),
        E.build_events(stale, ts_ms=F.unix_millis(t.now), message=F.concat(F.lit("run timed out for "), "pipeline_id"),
                       detail={"source": F.lit("watchdog"), "actionHint": F.lit("check run history"),
                               "status": F.col("new_status")}),
        E.build_events(jobs, ts_ms=F.col("event_ms"), message=F.concat(F.lit("job "), "event", F.lit(" for "), "pipeline_id"),
                       detail={"status": F.when(failed, F.col("event")), "source": F.when(failed, "job-log"),
                               "deadline": F.when(F.col("event") == "timeout", "08:00"),
                               "breachAt": F.when((F.col("event") == "timeout") & (F.col("seq") % 2 == 0), "09:00"),
                               "actionHint": F.when(F.col("event") == "fail", F.col("failure"))}))


EVENTS = f"""
    SELECT 'LATE_DATA_ARRIVAL' AS event_type, {KEYS}, ts_ms, 'late data for ' || pipeline_id AS message,
      NULL AS status, NULL AS source, NULL AS deadline, NULL AS breach_at, NULL AS hint
    FROM (SELECT h.* FROM hits h JOIN trig t USING ({KEYS}) JOIN latest l USING ({KEYS})
      WHERE NOT h.dry_run AND t.status = 'COMPLETED' AND l.event = 'success' AND h.ts_ms > l.event_ms
        AND NOT {excluded(local('h.ts', 'h.tz'), 'h')}
      QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY h.ts_ms, h.seq) = 1)
    UNION ALL SELECT 'SFN_TIMEOUT', {KEYS}, epoch_us({NOW}) // 1000, 'run timed out for ' || pipeline_id, 'FAILED_FINAL',
      'watchdog', NULL, NULL, 'check run history' FROM ({W1_SQL})
    UNION ALL SELECT CASE event WHEN 'success' THEN 'JOB_COMPLETED' WHEN 'fail' THEN 'JOB_FAILED'
        ELSE 'JOB_POLL_EXHAUSTED' END, {KEYS}, event_ms, 'job ' || event || ' for ' || pipeline_id,
      CASE WHEN event <> 'success' THEN event END, CASE WHEN event <> 'success' THEN 'job-log' END,
      CASE WHEN event = 'timeout' THEN '08:00' END, CASE WHEN event = 'timeout' AND seq % 2 = 0 THEN '09:00' END,
      CASE WHEN event = 'fail' THEN CASE WHEN error LIKE '%status 4%' THEN 'PERMANENT' ELSE 'TRANSIENT' END END FROM jlog"""


@query("e1_build_events", f"""
    SELECT event_type, {KEYS}, ts_ms, message, CAST(status IS NOT NULL AS INT) + (source IS NOT NULL)::INT
      + (deadline IS NOT NULL)::INT + (breach_at IS NOT NULL)::INT + (hint IS NOT NULL)::INT AS n_detail, source AS detail_source
    FROM evts""", {"evts": EVENTS})
def e1(t: Tables):
    e = _decision_events(t)
    return e.select("event_type", *RUN_KEY, "ts_ms", "message", F.size("detail").alias("n_detail"),
                    V.field(F.col("detail"), F.lit("source")).alias("detail_source"))


@query("e2_alert_routing", "SELECT event_type, count(*) AS n FROM evts GROUP BY event_type", {"evts": EVENTS})
def e2(t: Tables):
    return E.alerts(_decision_events(t)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("e3_alert_text", f"""
    SELECT {KEYS}, ts_ms, CASE WHEN event_type IN ('JOB_FAILED', 'SFN_TIMEOUT', 'JOB_POLL_EXHAUSTED') THEN 'severe'
        ELSE 'info' END AS severity,
      CASE WHEN event_type IN ('JOB_FAILED', 'SFN_TIMEOUT', 'JOB_POLL_EXHAUSTED') THEN '{E.MARKS["severe"]}'
        ELSE '{E.MARKS["info"]}' END || ' *' || event_type || '* | ' || pipeline_id || ' | ' || exec_date ||
      CASE WHEN source IS NULL THEN chr(10) || message ELSE chr(10) || concat_ws(' · ',
        'Deadline ' || deadline || CASE WHEN breach_at IS NULL THEN '' ELSE ' (' || breach_at || ')' END,
        'Status: ' || status, 'Source: ' || source) || coalesce(chr(10) || '→ ' || hint, '') END AS text
    FROM evts""", {"evts": EVENTS})
def e3(t: Tables):
    return E.alert_text(E.alerts(_decision_events(t))).select(*RUN_KEY, "ts_ms", "severity", "text")


E4_SQL = f"""
    SELECT {KEYS}, ts_ms, event_type, message, first_value(message) OVER w AS thread_message, ts_ms = min(ts_ms) OVER
      (PARTITION BY {KEYS}) AND message = first_value(message) OVER w AS opens_thread
    FROM evts WINDOW w AS (PARTITION BY {KEYS} ORDER BY ts_ms, message)"""


@query("e4_threads", E4_SQL, {"evts": EVENTS})
def e4(t: Tables):
    a = E.alerts(_decision_events(t))
    out = E.threads(a.withColumn("event_id", F.struct("ts_ms", "message")), order=["event_id"])
    return out.select(*RUN_KEY, "ts_ms", "event_type", "message", F.col("thread_id.message").alias("thread_message"),
                      "opens_thread")


def _alarm_metrics(t: Tables):
    """Error counts and lag samples from ``events``: one metric row per event."""
    e = t.table("events")
    lag = F.col("event_type") == "view"
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.when(lag, "lag-").otherwise("errors-"), "event_type").alias("name"),
        F.when(lag, "max").otherwise("sum").alias("stat"),
        F.when(lag, 300_000).otherwise(1).cast("bigint").alias("threshold"),
        F.when(lag, F.floor(F.col("value") * 10_000)).otherwise(
            F.when((F.col("event_type") == "error") & (F.col("value") > 20), 1).otherwise(0)).cast("bigint").alias("value"))


PERIODS = """
    SELECT name, threshold, period_start, CASE WHEN stat = 'max' THEN mx ELSE sm END AS value,
      CASE WHEN stat = 'max' THEN mx ELSE sm END >= threshold AS alarm
    FROM (SELECT name, stat, threshold, time_bucket(INTERVAL 5 MINUTE, ts) AS period_start, CAST(sum(v) AS BIGINT) AS sm,
      max(v) AS mx FROM (SELECT ts, CASE WHEN event_type = 'view' THEN 'lag-' ELSE 'errors-' END || event_type AS name,
        CASE WHEN event_type = 'view' THEN 'max' ELSE 'sum' END AS stat,
        CAST(CASE WHEN event_type = 'view' THEN 300000 ELSE 1 END AS BIGINT) AS threshold,
        CAST(CASE WHEN event_type = 'view' THEN floor(value * 10000) WHEN event_type = 'error' AND value > 20 THEN 1 ELSE 0
          END AS BIGINT) AS v FROM events) GROUP BY ALL)"""
TRANSITIONS = """
    SELECT name, period_start, value, CASE WHEN alarm THEN 'ALARM' ELSE 'OK' END AS state FROM (
      SELECT *, coalesce(lag(alarm) OVER w AND epoch(period_start) - epoch(lag(period_start) OVER w) <= 300, FALSE) AS before
      FROM periods WINDOW w AS (PARTITION BY name ORDER BY period_start)) WHERE alarm <> before"""


@query("e5_alarm_events", """
    SELECT 'INFRA_ALARM' AS event_type, 'INFRASTRUCTURE' AS pipeline_id, epoch_us(period_start) // 1000 AS ts_ms,
      name || ': ' || state || ' — value ' || value AS message FROM transitions""",
       {"periods": PERIODS, "transitions": TRANSITIONS})
def e5(t: Tables):
    return E.alarm_events(E.alarm_transitions(E.alarm_periods(_alarm_metrics(t))))


@query("e6_alarm_periods", """
    SELECT name, threshold, CAST(epoch(period_start) AS BIGINT) AS period_s, value, alarm FROM periods""",
       {"periods": PERIODS})
def e6(t: Tables):
    return E.alarm_periods(_alarm_metrics(t)).select(
        "name", "threshold", secs(F.col("period_start")).alias("period_s"), "value", "alarm")


def _records(t: Tables):
    e = t.table("events")
    kind = F.when((F.col("event_type") == "error") & (F.col("value") > 50), "schema").when(F.col("value") < 1, "timeout")
    return Q.split_outcomes(e.select(
        "event_id", F.floor(F.col("event_id") / 10).cast("bigint").alias("batch_id"), "event_type",
        kind.alias("error_kind"), (F.col("event_id") % 5 != 0).alias("dlq_ok"), cents(F.col("value")).alias("duration")))


OUTCOMES = """
    SELECT event_id, event_id // 10 AS batch_id, event_type, CAST(round(value * 100) AS BIGINT) AS duration,
      CASE WHEN event_type = 'error' AND value > 50 THEN CASE WHEN event_id % 5 <> 0 THEN 'dead_letter' ELSE 'retry' END
        WHEN value < 1 THEN 'retry' ELSE 'processed' END AS outcome FROM events"""


@query("e7_metrics", """
    SELECT event_type, count(*) AS n_records, count(*) FILTER (outcome = 'dead_letter') AS n_dead,
      CAST(sum(duration) AS BIGINT) AS duration_sum, max(duration) AS duration_max,
      quantile_disc(duration, 0.5) AS duration_p50, quantile_disc(duration, 0.95) AS duration_p95
    FROM outs GROUP BY event_type""",
       {"outs": OUTCOMES})
def e7(t: Tables):
    return E.metrics(_records(t), by=["event_type"])


# ---- accounting ------------------------------------------------------------------------------------------

@query("q1_batch_split", """
    SELECT batch_id, count(*) FILTER (outcome = 'processed') AS processed, count(*) FILTER (outcome = 'dead_letter')
      AS dead_lettered, count(*) FILTER (outcome = 'retry') AS retried, count(*) AS total, TRUE AS balanced
    FROM outs GROUP BY batch_id""", {"outs": OUTCOMES})
def q1(t: Tables):
    return Q.batch_stats(_records(t))


@query("q2_error_class", """
    SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'permanent' WHEN value < 1 THEN 'transient'
      ELSE 'permanent' END AS error_class FROM events""")
def q2(t: Tables):
    return _records(t).select("event_id", Q.error_class(F.col("error_kind")).alias("error_class"))


Q3 = """
    SELECT coalesce(s.id, o.id) AS id, CASE WHEN s.id IS NULL THEN 'UNKNOWN' ELSE coalesce(target, 'PENDING') END AS state,
      coalesce(n, 0) - CASE WHEN s.id IS NOT NULL AND target IS NOT NULL THEN 1 ELSE 0 END AS n_invalid
    FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P') s FULL JOIN (
      SELECT l_orderkey AS id, count(*) AS n, arg_min(CASE l_returnflag WHEN 'A' THEN 'ACKED' ELSE 'REJECTED' END,
        (l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'ACKED' ELSE 'REJECTED' END))
        FILTER (l_returnflag <> 'N') AS target FROM lineitem GROUP BY 1) o ON s.id = o.id"""


def _reconciled(t: Tables):
    sent = t.table("orders").filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("id"))
    flag = F.col("l_returnflag")
    outcomes = t.table("lineitem").select(
        F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey",
        F.when(flag == "A", "ACKED").when(flag == "R", "REJECTED").otherwise("PENDING").alias("target"))
    return Q.reconcile(sent, outcomes, order=["l_linenumber", "l_partkey"])


@query("q3_reconcile", "SELECT * FROM rec", {"rec": Q3})
def q3(t: Tables):
    return _reconciled(t)


@query("q3_report", """
    SELECT count(*) FILTER (state <> 'UNKNOWN') AS total_tracked, count(*) FILTER (state = 'PENDING') AS pending,
      count(*) FILTER (state = 'ACKED') AS acked, count(*) FILTER (state = 'REJECTED') AS rejected,
      CAST(sum(n_invalid) AS BIGINT) AS invalid_transitions FROM rec""", {"rec": Q3})
def q3_report(t: Tables):
    return Q.report(_reconciled(t))


@query("q4_record_errors", """
    SELECT pipeline_id, seq, CASE WHEN seq % 50 = 1 THEN 'missing key' WHEN seq % 50 = 2 THEN 'unexpected pk'
      WHEN seq % 50 = 3 THEN 'invalid sk' END AS error FROM jlog""")
def q4(t: Tables):
    """Damaged keys are reported per record while the others go on."""
    n = F.col("seq") % 50
    rows = S.job_log_rows(t.job_log, keep=["seq", "pipeline_id"]).select("pk", "sk", "seq", "pipeline_id")
    broken = rows.withColumns({
        "pk": F.when(n == 1, "").when(n == 2, F.concat(F.lit("X#"), "pipeline_id")).otherwise(F.col("pk")),
        "sk": F.when(n == 3, "JOB#cron").otherwise(F.col("sk"))}).withColumnRenamed("pipeline_id", "_id")
    from slipway.operators.clean import split_keys

    routed = split_keys(S.route_changes(broken))
    return routed.select(F.col("_id").alias("pipeline_id"), "seq", F.coalesce("error", "key_error").alias("error"))


@query("q5_replay", """
    SELECT event_id, event_id % 5 + 1 AS attempts, 'again' AS decision FROM outs WHERE outcome = 'dead_letter'
      AND event_id % 5 < 3
    UNION ALL SELECT event_id, event_id % 5, 'given up' FROM outs WHERE outcome = 'dead_letter' AND event_id % 5 >= 3""",
       {"outs": OUTCOMES})
def q5(t: Tables):
    rejects = _records(t).filter(F.col("outcome") == "dead_letter").select(
        "event_id", (F.col("event_id") % 5).alias("attempts"))
    again, given_up = Q.replayable(rejects)
    return again.withColumn("decision", F.lit("again")).unionByName(given_up.withColumn("decision", F.lit("given up")))


@query("q5_replay_runs", """
    SELECT event_id, CASE WHEN made < 3 AND greatest(made + 1, need) <= 3 THEN greatest(made + 1, need)
        ELSE greatest(made, 3) END AS attempts,
      CASE WHEN made < 3 AND greatest(made + 1, need) <= 3 THEN 'recovered' ELSE 'given up' END AS decision
    FROM (SELECT event_id, event_id % 5 AS made, event_id % 7 AS need FROM outs WHERE outcome = 'dead_letter')""",
       {"outs": OUTCOMES})
def q5_runs(t: Tables):
    """Rejects run again until they pass or are given up; a record passes from its (event_id % 7)th attempt on."""
    rejects = _records(t).filter(F.col("outcome") == "dead_letter").select(
        "event_id", (F.col("event_id") % 5).alias("attempts"))
    ok, given_up = Q.replay(rejects, lambda again: again.withColumn("error_kind", F.when(
        F.col("attempts") < F.col("event_id") % 7, "invalid")))
    cols = ["event_id", "attempts", "decision"]
    return ok.withColumn("decision", F.lit("recovered")).select(*cols).unionByName(
        given_up.withColumn("decision", F.lit("given up")).select(*cols))
