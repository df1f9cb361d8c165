"""Scans, sinks, cleansing, rules and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from slipway.functions import values as V, zones as Z
from slipway.operators import calendars as C, clean as P, rules as R
from slipway.plans.registry import Tables, cents, query, secs
from slipway.plans.views import NOW, excluded, local
from slipway.schema import RUN_KEY
from slipway.session import work_dir
from slipway.sources import control as S

KEYS = "pipeline_id, schedule_id, exec_date"
VALUES_JSON = """json_object('count', value, 'k', k)"""
CONFIG_SQL = """
    SELECT pipeline_id, cron, mode, max_retries, dry_run, sla_deadline, CAST(NULL AS VARCHAR) AS error,
      (SELECT count(*) FROM rules r WHERE r.pipeline_id = c.pipeline_id) AS n_rules,
      (SELECT max(num) FROM rules r WHERE r.pipeline_id = c.pipeline_id AND pos = 0) AS first_value
    FROM cfg c"""


def _config_columns(df):
    c = F.col("cfg")
    return df.select(
        "pipeline_id", c["schedule"]["cron"].alias("cron"), c["validation"]["trigger"].alias("mode"),
        c["job"]["maxRetries"].alias("max_retries"), c["dryRun"].alias("dry_run"),
        c["sla"]["deadline"].alias("sla_deadline"), "error",
        F.size(c["validation"]["rules"]).cast("bigint").alias("n_rules"),
        V.number(F.get(c["validation"]["rules"], F.lit(0))["value"]).cast("bigint").alias("first_value"))


@query("s1_scan_configs", CONFIG_SQL)
def s1(t: Tables):
    return _config_columns(S.scan_configs(t.control))


@query("s2_config_files", CONFIG_SQL)
def s2(t: Tables):
    path = work_dir(t.spark, "configs")
    S.write_json(t.configs.select("cfg.*"), path)
    return _config_columns(S.load_config_files(t.spark, path))


@query("s3_calendars", """
    SELECT name, CAST(count(*) FILTER (wday IS NOT NULL) AS BIGINT) AS n_days, count(date) AS n_dates,
      min(date) AS first_date, max(date) AS last_date FROM cals GROUP BY name""")
def s3(t: Tables):
    path = work_dir(t.spark, "calendars")
    S.write_json(t.calendars, path)
    return S.load_calendars(t.spark, path).filter("error is null").select(
        "name", F.size("days").cast("bigint").alias("n_days"), F.size("dates").cast("bigint").alias("n_dates"),
        F.array_min("dates").alias("first_date"), F.array_max("dates").alias("last_date"))


@query("s4_all_sensors", """
    SELECT pipeline_id, sensor_key, seq, CAST(round(value * 100) AS BIGINT) AS cents, status FROM slog""")
def s4(t: Tables):
    typed = P.type_attributes(S.all_sensors(t.control), "data")
    d = F.col("data")
    return typed.select("pipeline_id", "sensor_key", "seq", cents(V.number(d["count"])).alias("cents"),
                        V.text(d["status"]).alias("status"))


@query("s5_lookup", f"""
    SELECT r.pipeline_id, r.schedule_id, r.exec_date, r.seq, t.status, t.ttl_epoch, c.mode
    FROM reqs r LEFT JOIN trig t USING ({KEYS}) LEFT JOIN cfg c ON c.pipeline_id = r.pipeline_id""")
def s5(t: Tables):
    req = t.rerun_requests.select(*RUN_KEY, "seq")
    cfg = t.configs.select("pipeline_id", F.col("cfg.validation.trigger").alias("mode"))
    return S.lookup(S.lookup(req, t.triggers, RUN_KEY), cfg, ["pipeline_id"])


@query("s6_running_triggers", "SELECT pipeline_id, schedule_id, exec_date, ttl_epoch FROM trig WHERE status = 'RUNNING'")
def s6(t: Tables):
    return P.split_keys(S.running_triggers(t.control)).select(*RUN_KEY, F.col("ttl").alias("ttl_epoch"))


@query("s7_trigger_for_date", f"""
    SELECT DISTINCT c.pipeline_id, c.schedule_id, strftime(s.ts, '%Y-%m-%d') AS exec_date,
      EXISTS (SELECT 1 FROM trig t WHERE t.pipeline_id = c.pipeline_id AND t.schedule_id = c.schedule_id
              AND starts_with(t.exec_date, strftime(s.ts, '%Y-%m-%d'))) AS found
    FROM cfg c JOIN slog s USING (pipeline_id)""")
def s7(t: Tables):
    days = t.sensor_log.select("pipeline_id", Z.day_text(F.col("ts")).alias("exec_date")).distinct()
    cfg = t.configs.select("pipeline_id", Z.schedule_id(F.col("cfg")).alias("schedule_id"))
    return S.has_trigger_for_date(days.join(cfg, "pipeline_id"), t.triggers)


@query("s8_route_changes", """
    SELECT route, count(*) AS n FROM (SELECT 'sensor' AS route FROM slog UNION ALL SELECT 'config' FROM cfg
      UNION ALL SELECT 'ignore' FROM trig UNION ALL SELECT 'rerun_request' FROM reqs
      UNION ALL SELECT 'job' FROM jlog) GROUP BY route""")
def s8(t: Tables):
    return S.route_changes(t.control).groupBy("route").agg(F.count("*").alias("n"))


@query("s9_upsert_sensors", """
    SELECT pipeline_id, sensor_key, ts_ms, seq, CAST(round(value * 100) AS BIGINT) AS cents, k FROM sens
    WHERE seq % 13 <> 0""")
def s9(t: Tables):
    log = t.sensor_log.withColumn("deleted", F.col("seq") % 13 == 0)
    out = S.latest_sensors(log, deleted=F.col("deleted"))
    d = F.col("data")
    return out.select("pipeline_id", "sensor_key", "ts_ms", "seq", cents(V.number(d["count"])).alias("cents"),
                      V.number(d["k"]).cast("bigint").alias("k"))


@query("s10_insert_if_absent", f"""
    SELECT pipeline_id, schedule_id, exec_date, min(ts_ms) AS ts_ms, arg_min(seq, (ts_ms, seq)) AS seq FROM live h
    WHERE NOT EXISTS (SELECT 1 FROM trig t WHERE t.pipeline_id = h.pipeline_id AND t.schedule_id = h.schedule_id
                      AND t.exec_date = h.exec_date)
    GROUP BY ALL""")
def s10(t: Tables):
    hits = R.excluded_hits(R.trigger_hits(t.sensor_log, R.valid_configs(t.configs)))
    return S.insert_if_absent(R.live_only(hits), t.triggers, RUN_KEY, ["ts_ms", "seq"], [])


@query("s11_transitions", f"""
    SELECT pipeline_id, schedule_id, exec_date,
      CASE act WHEN 'reset' THEN 'RUNNING' WHEN 'set' THEN 'FAILED_FINAL' ELSE status END AS status,
      CASE act WHEN 'reset' THEN at_s + 16200 WHEN 'set' THEN NULL ELSE ttl_epoch END AS ttl_epoch
    FROM trig LEFT JOIN (
      SELECT pipeline_id, schedule_id, exec_date, at_ms // 1000 AS at_s,
        CASE reason WHEN 'manual' THEN 'release' WHEN '' THEN 'set' ELSE 'reset' END AS act
      FROM (SELECT *, requested_ms AS at_ms FROM reqs) QUALIFY row_number() OVER (
        PARTITION BY {KEYS} ORDER BY at_ms DESC, reason DESC, seq DESC) = 1) USING ({KEYS})
    WHERE act IS DISTINCT FROM 'release'""")
def s11(t: Tables):
    from slipway.functions.ordered import latest_by

    last = latest_by(t.rerun_requests, RUN_KEY, ["requested_ms", "reason", "seq"], [])
    moves = last.select(
        *RUN_KEY,
        F.when(F.col("reason") == "manual", "release").when(F.col("reason") == "", "set").otherwise("reset")
        .alias("action"),
        F.lit("FAILED_FINAL").alias("status"), F.floor(F.col("requested_ms") / 1000).cast("bigint").alias("at"))
    return S.apply_transitions(t.triggers, moves)


@query("s12_append_job_events", """
    SELECT 'PIPELINE#' || pipeline_id AS pk, 'JOB#' || schedule_id || '#' || exec_date || '#' || event_ms AS sk, event,
      error, nullif(duration, 0) AS duration, run_id, category, event_ms // 1000 + 2592000 AS ttl_epoch FROM jlog""")
def s12(t: Tables):
    path = work_dir(t.spark, "joblog")
    S.append(S.job_log_rows(t.job_log), path)
    return t.spark.read.parquet(path)


@query("s13_number_reruns", f"""
    SELECT q.pipeline_id, q.schedule_id, q.exec_date, q.reason, q.requested_ms AS triggered_ms, q.seq,
      coalesce(n, 0) + row_number() OVER (PARTITION BY q.pipeline_id, q.schedule_id, q.exec_date
        ORDER BY q.requested_ms, q.reason, q.seq) - 1 AS attempt
    FROM reqs q LEFT JOIN (SELECT {KEYS}, count(*) AS n FROM reruns GROUP BY ALL) USING ({KEYS})""")
def s13(t: Tables):
    return S.number_reruns(t.rerun_requests.withColumnRenamed("requested_ms", "triggered_ms"), t.reruns)


EVENT_SQL = f"""
    SELECT 'PIPELINE#' || pipeline_id AS pk, event_ms || '#' || etype AS sk, etype AS event_type, pipeline_id,
      schedule_id, exec_date, 'job ' || event || ' for ' || pipeline_id AS message, event_ms AS ts_ms,
      (epoch_us({NOW}) // 1000) // 1000 + 7776000 AS ttl_epoch
    FROM (SELECT *, CASE event WHEN 'success' THEN 'JOB_COMPLETED' WHEN 'fail' THEN 'JOB_FAILED'
      ELSE 'JOB_POLL_EXHAUSTED' END AS etype FROM jlog)"""


def _job_events(t: Tables):
    e = F.col("event")
    return t.job_log.select(
        *RUN_KEY, F.col("event_ms").alias("ts_ms"),
        F.when(e == "success", "JOB_COMPLETED").when(e == "fail", "JOB_FAILED").otherwise("JOB_POLL_EXHAUSTED")
        .alias("event_type"), F.concat(F.lit("job "), e, F.lit(" for "), "pipeline_id").alias("message"))


@query("s14_event_sink", EVENT_SQL)
def s14(t: Tables):
    path = work_dir(t.spark, "events")
    S.write_events(S.event_rows(_job_events(t), now=t.now), path)
    return t.spark.read.parquet(path).drop("event_day")


@query("s15_events_by_type", f"""
    SELECT pipeline_id, schedule_id, exec_date, ts_ms, message FROM ({EVENT_SQL}) WHERE event_type = 'JOB_FAILED'
      AND ts_ms BETWEEN (epoch_us(TIMESTAMP '2023-12-01') // 1000) AND (epoch_us(TIMESTAMP '2024-01-15 12:00:00') // 1000)""")
def s15(t: Tables):
    path = work_dir(t.spark, "events")
    S.write_events(S.event_rows(_job_events(t), now=t.now), path)
    lo, hi = (F.unix_millis(F.lit(x).cast("timestamp")) for x in ("2023-12-01 00:00:00", "2024-01-15 12:00:00"))
    return S.query_events(t.spark.read.parquet(path), "JOB_FAILED", lo, hi).select(*RUN_KEY, "ts_ms", "message")


@query("s16_expire", f"""
    SELECT pipeline_id, schedule_id, exec_date, status, ttl_epoch FROM trig
    WHERE ttl_epoch IS NULL OR ttl_epoch > (epoch_us({NOW}) // 1000) // 1000""")
def s16(t: Tables):
    return S.unexpired(t.triggers, now=t.now)


@query("s17_dead_letters", """
    SELECT pipeline_id, 'PERMANENT' AS error_type, 'value out of range' AS error, seq AS original_seq
    FROM slog WHERE event_type = 'error' AND value > 50""")
def s17(t: Tables):
    bad = t.sensor_log.filter(F.col("sensor_key").startswith("error") & (V.number(F.col("data")["count"]) > 50))
    path = work_dir(t.spark, "dead")
    S.append(S.dead_letters(bad.withColumns({"error": F.lit("value out of range"), "error_type": F.lit("PERMANENT")})),
             path)
    back = t.spark.read.parquet(path)
    return back.select("pipeline_id", "error_type", "error",
                       F.get_json_object("payload", "$.seq").cast("bigint").alias("original_seq"))


# ---- cleansing -------------------------------------------------------------------------------------------

@query("p1_unwrap", """
    SELECT pipeline_id, seq, CASE WHEN seq % 2 = 0 THEN CAST(round(value * 100) AS BIGINT) END AS stream_cents,
      CASE WHEN seq % 2 = 0 THEN 7 ELSE 3 END + CASE WHEN u % 6 = 1 AND seq % 2 = 0 THEN 1 ELSE 0 END AS n_fields,
      seq % 2 = 0 AS pull_found
    FROM slog""")
def p1(t: Tables):
    flat = F.create_map(
        F.lit("PK"), F.col("pipeline_id").cast("variant"), F.lit("SK"), F.col("sensor_key").cast("variant"),
        F.lit("ttl"), F.lit(1).cast("variant"), F.lit("a"), F.lit("x").cast("variant"),
        F.lit("b"), F.lit(True).cast("variant"), F.lit("seq"), F.col("seq").cast("variant"))
    nested = F.create_map(F.lit("PK"), F.col("pipeline_id").cast("variant"), F.lit("data"),
                          F.to_variant_object("data"))
    img = t.sensor_log.select("pipeline_id", "seq",
                              F.when(F.col("seq") % 2 == 0, nested).otherwise(flat).alias("image"))
    out = P.unwrap_image(P.unwrap_image(img, mode="stream").withColumnRenamed("data", "s"), mode="pull")
    return out.select("pipeline_id", "seq", cents(V.number(V.field(F.col("s"), F.lit("count")))).alias("stream_cents"),
                      F.size("s").alias("n_fields"), F.col("data").isNotNull().alias("pull_found"))


@query("p2_typing", """
    SELECT pipeline_id, seq, CAST(round(value * 100) AS BIGINT) AS cents, k, status, date_s, hour_s,
      CASE WHEN seq % 7 = 0 THEN 'text' ELSE 'number' END AS updated_kind
    FROM slog""")
def p2(t: Tables):
    js = t.sensor_log.select("pipeline_id", "seq", F.to_json("data").alias("j"))
    d = F.col("data")
    return P.type_attributes(js, "j").select(
        "pipeline_id", "seq", cents(V.number(d["count"])).alias("cents"), V.number(d["k"]).cast("bigint").alias("k"),
        V.text(d["status"]).alias("status"), V.text(d["date"]).alias("date_s"),
        V.text(V.field(d, F.lit("hour"))).alias("hour_s"),
        F.when(V.is_number(d["updatedAt"]), "number").otherwise("text").alias("updated_kind"))


@query("p3_split_keys", """
    SELECT kind, count(*) AS n, count(schedule_id) AS n_schedule, count(exec_date) AS n_date, min(exec_date) AS lo,
      max(exec_date) AS hi, sum(event_ms) AS ms, CAST(0 AS BIGINT) AS n_bad
    FROM (SELECT 'job' AS kind, schedule_id, exec_date, event_ms FROM jlog
      UNION ALL SELECT 'trigger', schedule_id, exec_date, NULL FROM trig
      UNION ALL SELECT 'rerun_request', schedule_id, exec_date, NULL FROM reqs
      UNION ALL SELECT 'sensor', NULL, NULL, NULL FROM slog UNION ALL SELECT 'config', NULL, NULL, NULL FROM cfg)
    GROUP BY kind""")
def p3(t: Tables):
    # Some five million epoch milliseconds add up to more than a BIGINT holds.
    return P.split_keys(t.control).groupBy("kind").agg(
        F.count("*").alias("n"), F.count("schedule_id").alias("n_schedule"), F.count("exec_date").alias("n_date"),
        F.min("exec_date").alias("lo"), F.max("exec_date").alias("hi"),
        F.sum(F.col("event_ms").cast("decimal(28,0)")).alias("ms"), F.count("key_error").alias("n_bad"))


@query("p4_execution_date", f"""
    SELECT pipeline_id, seq, exec_date, substr(exec_date, 1, 10) AS date_part, coalesce(hour_s, '') AS hour_part
    FROM slog""")
def p4(t: Tables):
    return P.execution_dates(t.sensor_log, now=t.now).select(
        "pipeline_id", "seq", "exec_date", "date_part", "hour_part")


@query("p5_period_remap", """
    SELECT w.pipeline_id, w.day AS exec_date, w.key, coalesce(a.sensor_key, b.sensor_key, c.sensor_key) AS sensor_key,
      coalesce(a.seq, b.seq, c.seq) AS k_seq
    FROM (SELECT DISTINCT s.pipeline_id, strftime(s.ts, '%Y-%m-%d') AS day, r.key FROM slog s
          JOIN rules r USING (pipeline_id)) w
    LEFT JOIN sens a ON a.pipeline_id = w.pipeline_id AND a.sensor_key = w.key || '#' || w.day
    LEFT JOIN sens b ON b.pipeline_id = w.pipeline_id AND b.sensor_key = w.key || '#' || replace(w.day, '-', '')
    LEFT JOIN sens c ON c.pipeline_id = w.pipeline_id AND c.sensor_key = w.key""")
def p5(t: Tables):
    days = t.sensor_log.select("pipeline_id", Z.day_text(F.col("ts")).alias("exec_date")).distinct()
    keys = t.configs.select("pipeline_id", F.explode(F.array_distinct(
        F.transform("cfg.validation.rules", lambda r: r["key"]))).alias("key"))
    sensors = t.sensors.withColumn("data", F.map_concat("data", F.create_map(
        F.lit("_seq"), F.col("seq").cast("variant"))))
    out = P.remap_periods(days.join(keys, "pipeline_id"), sensors)
    return out.select("pipeline_id", "exec_date", "key", "sensor_key",
                      V.number(V.field(F.col("data"), F.lit("_seq"))).cast("bigint").alias("k_seq"))


@query("p6_run_plan", """
    SELECT pipeline_id, schedule_id, tz AS zone, CAST(eval_interval AS BIGINT) AS eval_interval_s,
      CAST(eval_window AS BIGINT) AS eval_window_s, CAST(60 AS BIGINT) AS poll_interval_s,
      CAST(CASE WHEN poll_window > 0 THEN poll_window ELSE 3600 END AS BIGINT) AS poll_window_s,
      CAST(16200 AS BIGINT) AS lock_s,
      eval_window + CASE WHEN poll_window > 0 THEN poll_window ELSE 3600 END > 14400 AS windows_exceed_timeout
    FROM cfg""")
def p6(t: Tables):
    return P.run_plan(t.configs)


@query("p7_run_parameters", """
    SELECT pipeline_id, schedule_id, exec_date, seq, run_id, job_type,
      CASE WHEN job_type = 'glue' THEN replace(substr(exec_date, 1, 10), '-', '') END AS par_day,
      CASE WHEN job_type = 'glue' AND length(exec_date) > 10 THEN substr(exec_date, 12) END AS par_hour,
      CASE WHEN job_type = 'http' THEN '{"par_day":"' || replace(substr(exec_date, 1, 10), '-', '') || '"' ||
        CASE WHEN length(exec_date) > 10 THEN ',"par_hour":"' || substr(exec_date, 12) || '"' ELSE '' END || '}' END
        AS body
    FROM jlog LEFT JOIN (SELECT pipeline_id, job_type FROM cfg) USING (pipeline_id)""")
def p7(t: Tables):
    types = t.configs.select("pipeline_id", F.col("cfg.job.type").alias("job_type"))
    meta = F.when(F.col("seq") % 2 == 0, F.create_map(F.lit("runId"), F.lit(""), F.lit("stepId"), F.col("run_id"))) \
        .otherwise(F.create_map(F.lit("jobRunId"), F.col("run_id")))
    runs = t.job_log.withColumns({"metadata": meta, "body": F.lit(None).cast("string")}).join(
        types, "pipeline_id", "left")
    out = P.run_parameters(runs)
    a = F.col("arguments")
    return out.select(*RUN_KEY, "seq", "run_id", "job_type", V.field(a, F.lit("--par_day")).alias("par_day"),
                      V.field(a, F.lit("--par_hour")).alias("par_hour"), "body")


# ---- rules -----------------------------------------------------------------------------------------------

def _verdicts(t: Tables):
    rules = R.explode_rules(t.configs, F.col("cfg.validation.rules"))
    return R.evaluate(R.match_sensors(rules, t.sensors), now=t.now)


def _rule_cols(df, *extra):
    return df.select("pipeline_id", F.col("pos").cast("bigint").alias("pos"), F.col("rule.key").alias("key"), *extra)


@query("r1_match", "SELECT pipeline_id, CAST(pos AS BIGINT) AS pos, key, found FROM verdicts")
def r1(t: Tables):
    m = R.match_sensors(R.explode_rules(t.configs, F.col("cfg.validation.rules")), t.sensors)
    return _rule_cols(m, F.col("data").isNotNull().alias("found"))


def _check_query(name: str, where_sql: str, where):
    @query(name, f"""
        SELECT pipeline_id, CAST(pos AS BIGINT) AS pos, key, reason_code IS NULL AS passed, reason_code FROM verdicts
        WHERE {where_sql}""")
    def q(t: Tables):
        return _rule_cols(_verdicts(t).filter(where), "passed", "reason_code")

    return q


_check_query("r2_exists", "chk = 'exists'", "rule.check = 'exists'")
_check_query("r3_missing", "reason_code IN ('missing_sensor', 'missing_field')",
             "reason_code IN ('missing_sensor', 'missing_field')")
_check_query("r4_equals", "chk = 'equals'", "rule.check = 'equals'")
_check_query("r5_numeric", "chk IN ('gt', 'gte', 'lt', 'lte')", "rule.check IN ('gt', 'gte', 'lt', 'lte')")
_check_query("r6_age_lt", "chk = 'age_lt'", "rule.check = 'age_lt'")
_check_query("r7_unknown", "chk = 'age_gt'", "rule.check = 'age_gt'")


@query("r8_combine", """
    SELECT c.pipeline_id, c.mode, count(v.pos) FILTER (v.reason_code IS NULL) AS n_passed, count(v.pos) AS n_rules,
      CASE WHEN upper(c.mode) = 'ANY' THEN count(v.pos) FILTER (v.reason_code IS NULL) > 0
        ELSE count(v.pos) FILTER (v.reason_code IS NULL) = count(v.pos) END AS passed
    FROM cfg c LEFT JOIN verdicts v USING (pipeline_id) GROUP BY c.pipeline_id, c.mode""")
def r8(t: Tables):
    cfg = t.configs.withColumn("mode", F.col("cfg.validation.trigger"))
    rules = R.explode_rules(cfg, F.col("cfg.validation.rules"), outer=True)
    results = R.evaluate(R.match_sensors(rules, t.sensors), now=t.now)
    return R.combine(results.withColumn("passed", F.col("passed") & F.col("pos").isNotNull()),
                     ["pipeline_id"]).select("pipeline_id", "mode", "n_passed", "n_rules", "passed")


R9_SQL = f"""
    SELECT pipeline_id, schedule_id, exec_date, mode, n_passed, n_rules, codes,
      CASE WHEN has_cfg IS NULL THEN 'error' WHEN passed THEN 'passed' ELSE 'not_ready' END AS status,
      CASE WHEN has_cfg AND passed THEN 'VALIDATION_PASSED' END AS event_type
    FROM (SELECT *, CASE WHEN upper(coalesce(mode, '')) = 'ANY' THEN n_passed > 0 ELSE n_passed = n_rules END AS passed
    FROM (
      SELECT t.pipeline_id, t.schedule_id, t.exec_date, c.mode, c.pipeline_id IS NOT NULL OR NULL AS has_cfg,
        count(r.pos) AS n_rules, count(r.pos) FILTER (code IS NULL) AS n_passed,
        coalesce(string_agg(CASE WHEN r.pos IS NOT NULL THEN coalesce(code, 'ok') END, ',' ORDER BY r.pos), '') AS codes
      FROM (SELECT pipeline_id, schedule_id, exec_date FROM trig
            UNION SELECT pipeline_id, schedule_id, day FROM cfg, (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM slog)) t
      LEFT JOIN cfg c USING (pipeline_id) LEFT JOIN rules r USING (pipeline_id)
      LEFT JOIN LATERAL (
        SELECT CASE WHEN r.chk = 'exists' AND s.seq IS NOT NULL THEN NULL
            WHEN s.seq IS NULL THEN 'missing_sensor'
            WHEN r.chk = 'equals' THEN CASE WHEN s.status <> 'ready' THEN 'not_equal' END
            WHEN r.chk = 'gte' THEN CASE WHEN NOT s.value >= r.num THEN 'compare_false' END
            WHEN r.chk = 'lt' THEN CASE WHEN NOT s.value < r.num THEN 'compare_false' END
            WHEN r.chk = 'age_lt' THEN CASE WHEN NOT (epoch_us({NOW}) // 1000) - (epoch_us(s.seen_at) // 1000) < 86400000
              THEN 'too_old' END
            ELSE 'unknown_operator' END AS code
        FROM (SELECT a.* FROM (SELECT 1) one LEFT JOIN (
            SELECT * FROM sens x WHERE x.pipeline_id = t.pipeline_id AND x.sensor_key IN (r.key,
              r.key || '#' || t.exec_date, r.key || '#' || replace(t.exec_date, '-', ''))
            ORDER BY CASE WHEN x.sensor_key = r.key THEN 2 WHEN contains(x.sensor_key, '-') THEN 0 ELSE 1 END LIMIT 1) a
          ON TRUE) s) v ON TRUE
      GROUP BY ALL))"""


def readiness_runs(t: Tables):
    """Known runs plus every (config, sensor day)."""
    days = t.sensor_log.select(Z.day_text(F.col("ts")).alias("d")).distinct().agg(F.sort_array(F.collect_list("d")))
    daily = t.configs.select("pipeline_id", Z.schedule_id(F.col("cfg")).alias("schedule_id"),
                             F.explode(days.scalar()).alias("exec_date"))  # there are few days
    return t.triggers.select(*RUN_KEY).union(daily).distinct()


@query("r9_readiness", R9_SQL)
def r9(t: Tables):
    out = R.readiness(readiness_runs(t), t.configs, t.sensors, now=t.now)
    codes = F.array_join(F.transform("results", lambda r: F.coalesce(r["reason_code"], F.lit("ok"))), ",")
    return out.select(*RUN_KEY, "mode", "n_passed", "n_rules", codes.alias("codes"), "status", "event_type")


@query("r10_trigger_hits", """
    SELECT pipeline_id, sensor_key, seq, ts_ms FROM slog JOIN cfg USING (pipeline_id)
    WHERE has_trigger AND starts_with(sensor_key, 'click') AND value > 1""")
def r10(t: Tables):
    return R.trigger_hits(t.sensor_log, t.configs).select("pipeline_id", "sensor_key", "seq", "ts_ms")


@query("r11_config_errors", """
    SELECT pipeline_id, CAST(e1 AS INT) + e2::INT + e3::INT + e4::INT + e5::INT + e6::INT + e8::INT + e9::INT
      + e11::INT + e13::INT AS n_errors,
      concat_ws('; ', CASE WHEN e1 THEN 'maxRetries' END, CASE WHEN e2 THEN 'maxDriftReruns' END,
        CASE WHEN e3 THEN 'maxManualReruns' END, CASE WHEN e4 THEN 'maxCodeRetries' END,
        CASE WHEN e5 THEN 'jobPollWindowSeconds' END) AS bounds
    FROM errs""")
def r11(t: Tables):
    out = R.config_errors(t.configs)
    bounds = F.filter("errors", lambda e: e.startswith("job."))
    names = F.transform(bounds, lambda e: F.regexp_extract(e, r"^job\.(\w+)", 1))
    return out.select("pipeline_id", F.size("errors").alias("n_errors"), F.array_join(names, "; ").alias("bounds"))


@query("r12_valid_configs", "SELECT pipeline_id, mode, job_type FROM okcfg")
def r12(t: Tables):
    c = F.col("cfg")
    return R.valid_configs(t.configs).select("pipeline_id", c["validation"]["trigger"].alias("mode"),
                                             c["job"]["type"].alias("job_type"))


# ---- calendars -------------------------------------------------------------------------------------------

@query("c1_excluded_time", f"""
    SELECT s.pipeline_id, s.seq, {excluded(local('s.ts', 'c.tz'))} AS excluded
    FROM slog s JOIN cfg c USING (pipeline_id)""")
def c1(t: Tables):
    return C.exclude_times(t.sensor_log, t.configs, at="ts").select("pipeline_id", "seq", "excluded")


@query("c2_excluded_date", f"""
    SELECT j.pipeline_id, j.exec_date, j.seq, {excluded("CAST(substr(j.exec_date, 1, 10) AS TIMESTAMP)")} AS excluded
    FROM jlog j JOIN cfg c USING (pipeline_id)""")
def c2(t: Tables):
    return C.exclude_dates(t.job_log, t.configs).select("pipeline_id", "exec_date", "seq", "excluded")


@query("c3_named_calendar", """
    SELECT j.pipeline_id, j.exec_date, j.seq, coalesce((calendar = 'weekend' AND dayofweek(d) IN (0, 6))
      OR (calendar = 'numbered' AND strftime(d, '%Y-%m-%d') IN (SELECT date FROM cals WHERE date IS NOT NULL)), FALSE)
      AS excluded
    FROM (SELECT *, CAST(substr(exec_date, 1, 10) AS TIMESTAMP) AS d FROM jlog) j JOIN cfg c USING (pipeline_id)""")
def c3(t: Tables):
    return C.exclude_named(t.job_log, t.configs, t.calendars).select("pipeline_id", "exec_date", "seq", "excluded")


@query("c4_recent_inclusion", """
    SELECT pipeline_id, max(d) AS exec_date FROM (SELECT pipeline_id, unnest(include_dates) AS d FROM cfg)
    WHERE d LIKE '2%-%' AND d <= '2024-01-30' GROUP BY pipeline_id""")
def c4(t: Tables):
    return C.most_recent_inclusion(t.configs, now=t.now)


@query("c5_past_inclusions", """
    SELECT pipeline_id, d AS exec_date, CAST(row_number() OVER (PARTITION BY pipeline_id ORDER BY d DESC) AS BIGINT)
      AS rank FROM (SELECT pipeline_id, unnest(include_dates) AS d FROM cfg)
    WHERE d LIKE '2%-%' AND d <= '2024-01-30' QUALIFY rank <= 3""")
def c5(t: Tables):
    return C.past_inclusions(t.configs, now=t.now).select(
        "pipeline_id", "exec_date", F.col("rank").cast("bigint").alias("rank"))


LAST_FIRE = f"""
    SELECT pipeline_id, schedule_id, tz, CASE WHEN cron LIKE '*/%' THEN NULL
      WHEN cron = '15 * * * *' THEN lnow_h + INTERVAL 15 MINUTE
        - CASE WHEN lnow_h + INTERVAL 15 MINUTE > lnow THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END
      WHEN cron = '30 6 * * *' THEN lday + INTERVAL 390 MINUTE
        - CASE WHEN lday + INTERVAL 390 MINUTE > lnow THEN INTERVAL 24 HOUR ELSE INTERVAL 0 HOUR END
      ELSE lday + INTERVAL 1365 MINUTE
        - CASE WHEN lday + INTERVAL 1365 MINUTE > lnow THEN INTERVAL 24 HOUR ELSE INTERVAL 0 HOUR END END AS fire_local
    FROM (SELECT *, {local(NOW, 'tz')} AS lnow, date_trunc('hour', {local(NOW, 'tz')}) AS lnow_h,
      CAST(date_trunc('day', {local(NOW, 'tz')}) AS TIMESTAMP) AS lday FROM cfg WHERE cron IS NOT NULL)"""


@query("c6_last_cron_fire", f"""
    SELECT pipeline_id, CAST(epoch(timezone(tz, fire_local)) AS BIGINT) AS fire_s FROM lf""", {"lf": LAST_FIRE})
def c6(t: Tables):
    return C.last_cron_fires(t.configs, now=t.now).select("pipeline_id", secs(F.col("last_fire")).alias("fire_s"))
