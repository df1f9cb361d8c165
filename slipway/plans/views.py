"""The fixture views again, as SQL common table expressions for the side-by-side check."""

from __future__ import annotations

import re

NOW = "TIMESTAMP '2024-01-30 21:30:00'"

VIEWS: dict[str, str] = {
    "zones": "SELECT name FROM pg_timezone_names()",
    "slog": """
        SELECT 'p' || user_id AS pipeline_id, user_id AS u,
          CASE user_id % 4 WHEN 2 THEN event_type || '#' || strftime(ts, '%Y-%m-%d')
            WHEN 3 THEN event_type || '#' || strftime(ts, '%Y%m%d') ELSE event_type END AS sensor_key,
          event_type, ts, (epoch_us(ts) // 1000) AS ts_ms, event_id AS seq, value,
          CASE WHEN event_id % 2 = 0 THEN 'ready' ELSE 'pending' END AS status,
          CASE WHEN user_id % 3 = 0 THEN strftime(ts, '%Y%m%d') ELSE strftime(ts, '%Y-%m-%d') END AS date_s,
          CASE WHEN user_id % 6 = 1 THEN strftime(ts, '%H') END AS hour_s,
          strftime(ts, '%Y-%m-%d') || CASE WHEN user_id % 6 = 1 THEN strftime(ts, 'T%H') ELSE '' END AS exec_date,
          CASE WHEN event_id % 7 <> 0 AND event_id % 5 = 0
            THEN ((epoch_us(ts) // 1000 - CASE WHEN user_id % 4 = 0 THEN 5184000000 ELSE 0 END) // 1000)
            ELSE epoch_us(ts) // 1000 - CASE WHEN user_id % 4 = 0 THEN 5184000000 ELSE 0 END END AS upd_raw,
          CASE WHEN event_id % 7 <> 0 AND event_id % 5 = 0
            THEN ((epoch_us(ts) // 1000 - CASE WHEN user_id % 4 = 0 THEN 5184000000 ELSE 0 END) // 1000) * 1000
            ELSE epoch_us(ts) // 1000 - CASE WHEN user_id % 4 = 0 THEN 5184000000 ELSE 0 END END AS upd_ms,
          date_trunc('second', ts) AS seen_at,
          CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events""",
    "sens": """
        SELECT * FROM slog QUALIFY row_number() OVER (
          PARTITION BY pipeline_id, sensor_key ORDER BY ts_ms DESC, seq DESC) = 1""",
    "users": "SELECT DISTINCT user_id AS u FROM events",
    "cfg": """
        SELECT u, 'p' || u AS pipeline_id,
          CASE u % 8 WHEN 0 THEN '30 6 * * *' WHEN 2 THEN '15 * * * *' WHEN 4 THEN '45 22 * * *'
            WHEN 6 THEN '*/5 3 * * *' END AS cron,
          CASE WHEN u % 2 = 0 THEN 'cron' ELSE 'stream' END AS schedule_id,
          CASE u % 5 WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Europe/London' WHEN 3 THEN 'Asia/Tokyo'
            WHEN 4 THEN 'Not/AZone' END AS tz_raw,
          CASE u % 5 WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Europe/London' WHEN 3 THEN 'Asia/Tokyo'
            ELSE 'UTC' END AS tz,
          u % 10 <> 9 AS has_trigger,
          CASE WHEN u % 10 <> 9 THEN CASE u % 6 WHEN 1 THEN ':30' WHEN 3 THEN '09:00' WHEN 5 THEN 'noon' END END
            AS trig_deadline,
          u % 5 = 0 AS excl_weekends,
          CASE WHEN u % 5 <> 0 AND u % 7 = 3 THEN ['2024-01-15', '2024-01-30'] ELSE CAST([] AS VARCHAR[]) END
            AS excl_dates,
          CASE WHEN u % 2 = 1 AND u % 3 = 2 THEN list_filter(['2024-01-05', '2024-01-12', '2024-01-26',
              CASE WHEN u % 9 = 5 THEN '2024-01-19' END, CASE WHEN u % 15 = 5 THEN '2024-01-30' END, '2024-02-09',
              CASE WHEN u % 27 = 5 THEN '26/01/2024' END], lambda x: x IS NOT NULL) END AS include_dates,
          CASE u % 4 WHEN 1 THEN 'weekend' WHEN 3 THEN 'numbered' END AS calendar,
          CASE u % 6 WHEN 2 THEN '22:00' WHEN 4 THEN '05:00' END AS sched_time,
          CASE u % 3 WHEN 0 THEN 3600 WHEN 1 THEN 1800 ELSE 5400 END AS eval_window,
          CASE WHEN u % 11 = 0 THEN 300 ELSE CASE u % 3 WHEN 0 THEN 300 WHEN 1 THEN 120 ELSE 600 END END
            AS eval_interval,
          u % 8 <> 7 AS has_sla,
          CASE WHEN u % 8 = 7 THEN NULL WHEN u % 6 = 1 THEN ':15'
            ELSE lpad(CAST(6 + u % 12 AS VARCHAR), 2, '0') || ':00' END AS sla_deadline,
          CASE WHEN u % 8 <> 7 AND u % 9 <> 8 THEN 1800 END AS exp_s,
          CASE WHEN u % 8 = 7 THEN NULL WHEN u % 13 = 5 THEN 90000 WHEN u % 4 = 1 THEN 14400 END AS max_s,
          CASE WHEN u % 8 = 7 THEN NULL WHEN u % 17 = 3 THEN 'Bad/Zone' WHEN u % 5 = 1 THEN 'America/New_York'
            WHEN u % 5 = 2 THEN 'Europe/London' WHEN u % 5 = 3 THEN 'Asia/Tokyo' END AS sla_tz,
          CASE u % 3 WHEN 0 THEN 'ANY' WHEN 1 THEN 'ALL' ELSE 'all' END AS mode,
          ['command', 'http', 'airflow', 'glue', 'emr', 'emr-serverless', 'step-function', 'databricks',
           'lambda'][u % 9 + 1] AS job_type,
          u % 12 AS max_retries,
          CASE WHEN u % 16 = 10 THEN 30 WHEN u % 4 = 1 THEN 1800 WHEN u % 4 = 2 THEN 7200 WHEN u % 4 = 3 THEN 0
            END AS poll_window,
          CASE WHEN u % 29 = 6 THEN 6 WHEN u % 5 <> 4 THEN u % 6 END AS max_drift,
          CASE WHEN u % 6 <> 5 THEN u % 4 END AS max_manual,
          CASE WHEN u % 31 = 7 THEN 9 WHEN u % 3 <> 0 THEN u % 4 END AS max_code,
          u % 9 <> 4 AS has_post,
          CASE WHEN u % 9 <> 4 THEN CASE u % 3 WHEN 1 THEN '90m' WHEN 2 THEN 'bad' END END AS sensor_timeout,
          CAST(u % 10 AS DOUBLE) AS drift_threshold,
          CASE WHEN u % 2 = 0 THEN 'count' ELSE 'sensor_count' END AS drift_field,
          u % 7 = 0 AS dry_run
        FROM users""",
    "rules": """
        SELECT u, 'p' || u AS pipeline_id, pos, key, chk, fld, num FROM users, LATERAL (VALUES
          (0, 'purchase', 'gte', 'count', 5 + u % 20, TRUE), (1, 'error', 'lt', 'count', 50, TRUE),
          (2, 'view', 'equals', 'status', NULL, TRUE), (3, 'signup', 'age_lt', 'seenAt', NULL, TRUE),
          (4, 'refund', 'exists', '', NULL, u % 10 = 0),
          (CASE WHEN u % 10 = 0 THEN 5 ELSE 4 END, 'view', 'age_gt', 'seenAt', NULL, u % 12 = 5)
        ) r(pos, key, chk, fld, num, used) WHERE used AND u % 14 <> 13""",
    "jlog": """
        SELECT pipeline_id, p, CASE WHEN p % 2 = 0 THEN 'cron' ELSE 'stream' END AS schedule_id,
          day_s || CASE WHEN p % 6 = 1 THEN 'T' || lpad(CAST(off_ms // 3600000 AS VARCHAR), 2, '0') ELSE '' END
            AS exec_date,
          (epoch_us(day) // 1000) AS day_ms, (epoch_us(day) // 1000) + off_ms AS event_ms, o_orderkey AS seq, o_orderkey,
          CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'fail' ELSE 'timeout' END AS event,
          CASE WHEN o_orderstatus = 'O' THEN 'job failed with status ' ||
            CASE WHEN o_orderpriority = '1-URGENT' THEN '404' ELSE '503' END END AS error,
          CAST(floor(o_totalprice) AS BIGINT) AS duration, 'r' || o_orderkey AS run_id,
          CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'PERMANENT'
            WHEN o_orderstatus = 'O' THEN 'TRANSIENT' ELSE 'TIMEOUT' END AS category
        FROM (SELECT *, strftime(day, '%Y-%m-%d') AS day_s, 'p' || p AS pipeline_id FROM (
          SELECT *, o_custkey % 150 AS p, (o_orderkey * 104729) % 86400000 AS off_ms,
            CAST(TIMESTAMP '2023-10-03' + to_days(CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) % 120
              AS INTEGER)) AS TIMESTAMP) AS day
          FROM orders))""",
    "latest": """
        SELECT * FROM jlog QUALIFY row_number() OVER (
          PARTITION BY pipeline_id, schedule_id, exec_date ORDER BY event_ms DESC, seq DESC) = 1""",
    "trig": """
        SELECT pipeline_id, schedule_id, exec_date,
          CASE WHEN seq % 11 = 0 THEN 'RUNNING' WHEN event = 'success' THEN 'COMPLETED' ELSE 'FAILED_FINAL' END
            AS status,
          CASE WHEN seq % 11 = 0 THEN event_ms // 1000 + 16200 END AS ttl_epoch
        FROM latest""",
    "lruns": """
        SELECT j.pipeline_id, j.schedule_id, j.exec_date, l_returnflag, l_linenumber,
          day_ms + (l_orderkey * 104729 + l_partkey * 7919 + l_suppkey * 31) % 86400000 AS at_ms,
          (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey % 1000 * 1000 + l_suppkey % 1000 AS seq
        FROM lineitem JOIN jlog j ON l_orderkey = j.o_orderkey""",
    "reruns": """
        SELECT pipeline_id, schedule_id, exec_date, at_ms AS triggered_ms, seq,
          CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'data-drift' ELSE 'manual' END
            ELSE 'job-fail-retry' END AS reason
        FROM lruns WHERE l_returnflag <> 'R'""",
    "reqs": """
        SELECT pipeline_id, schedule_id, exec_date, at_ms AS requested_ms, seq,
          CASE l_linenumber % 4 WHEN 0 THEN 'data-drift' WHEN 1 THEN 'late-data' WHEN 2 THEN 'manual' ELSE '' END
            AS reason
        FROM lruns WHERE l_returnflag = 'R'""",
    "cals": """
        SELECT 'numbered' AS name, NULL AS wday, strftime(DATE '2024-01-01' + CAST(n_nationkey AS INTEGER),
          '%Y-%m-%d') AS date FROM nation
        UNION SELECT 'weekend', 6, NULL UNION SELECT 'weekend', 0, NULL""",
    # Config validity (bounds, exclusive schedule kinds, relative SLA and observation requirements).
    "errs": """
        SELECT pipeline_id, u, max_retries NOT BETWEEN 0 AND 10 AS e1, coalesce(max_drift NOT BETWEEN 0 AND 5, FALSE) AS e2,
          coalesce(max_manual NOT BETWEEN 0 AND 5, FALSE) AS e3, coalesce(max_code NOT BETWEEN 0 AND 3, FALSE) AS e4,
          coalesce(poll_window <> 0 AND poll_window NOT BETWEEN 60 AND 86400, FALSE) AS e5,
          cron IS NOT NULL AND include_dates IS NOT NULL AS e6,
          coalesce(list_contains(include_dates, '26/01/2024'), FALSE) AS e8,
          max_s IS NOT NULL AND NOT has_trigger AS e9, coalesce(max_s > 86400, FALSE) AS e11,
          dry_run AND NOT has_trigger AS e13
        FROM cfg""",
    "okcfg": """
        SELECT cfg.* FROM cfg JOIN errs USING (pipeline_id)
        WHERE NOT (e1 OR e2 OR e3 OR e4 OR e5 OR e6 OR e8 OR e9 OR e11 OR e13)""",
    # Rule verdicts against the current sensors, per rule, without period suffixes.
    "verdicts": f"""
        SELECT r.*, s.pipeline_id IS NOT NULL AS found,
          CASE WHEN chk = 'exists' AND s.pipeline_id IS NOT NULL THEN NULL
            WHEN s.pipeline_id IS NULL THEN 'missing_sensor'
            WHEN chk = 'equals' THEN CASE WHEN s.status <> 'ready' THEN 'not_equal' END
            WHEN chk = 'gte' THEN CASE WHEN NOT s.value >= num THEN 'compare_false' END
            WHEN chk = 'lt' THEN CASE WHEN NOT s.value < num THEN 'compare_false' END
            WHEN chk = 'age_lt' THEN CASE WHEN NOT (epoch_us({NOW}) // 1000) - (epoch_us(s.seen_at) // 1000) < 86400000 THEN 'too_old' END
            ELSE 'unknown_operator' END AS reason_code
        FROM rules r LEFT JOIN sens s ON s.pipeline_id = r.pipeline_id AND s.sensor_key = r.key""",
    # Run state per run from the latest job event, with the planned deadline clock at the start of its day.
    "arrivals": """
        SELECT pipeline_id, schedule_id, exec_date, ts_ms AS arrival_ms, seq FROM live QUALIFY row_number() OVER (
          PARTITION BY pipeline_id, schedule_id, exec_date ORDER BY ts_ms, seq) = 1""",
    "marks": "SELECT DISTINCT pipeline_id, exec_date FROM reqs WHERE reason = ''",
    "finished": """
        SELECT pipeline_id, schedule_id, exec_date FROM trig WHERE status <> 'RUNNING'
        UNION SELECT pipeline_id, schedule_id, exec_date FROM latest""",
    "fresh": "SELECT pipeline_id, max(upd_ms) AS max_upd FROM sens GROUP BY pipeline_id",
    "bl": """
        SELECT l.pipeline_id, l.schedule_id, l.exec_date, l.event_ms AS captured_ms, 'purchase' AS rule_key,
          s.ts_ms AS sensor_ms, s.seq AS sensor_seq, s.value AS base_value
        FROM latest l JOIN cfg c USING (pipeline_id) JOIN slog s ON s.pipeline_id = l.pipeline_id
          AND s.event_type = 'purchase' AND s.ts_ms <= l.event_ms AND s.sensor_key IN ('purchase',
            'purchase#' || l.exec_date, 'purchase#' || replace(l.exec_date, '-', ''))
        WHERE l.event = 'success' AND c.has_post
        QUALIFY row_number() OVER (PARTITION BY l.pipeline_id, l.schedule_id, l.exec_date ORDER BY
          CASE WHEN s.sensor_key = 'purchase' THEN 2 WHEN contains(s.sensor_key, '-') THEN 0 ELSE 1 END,
          s.ts_ms DESC, s.seq DESC) = 1""",
    "postm": """
        SELECT s.*, c.schedule_id, c.drift_threshold, c.excl_weekends, c.excl_dates, c.dry_run FROM slog s
        JOIN okcfg c USING (pipeline_id) WHERE c.has_post AND c.has_trigger AND s.event_type = 'purchase'""",
    # Sensor rows that meet their pipeline's trigger condition.
    "hits": """
        SELECT s.*, c.schedule_id, c.tz, c.excl_weekends, c.excl_dates, c.dry_run, c.max_s, c.exp_s
        FROM slog s JOIN okcfg c USING (pipeline_id)
        WHERE c.has_trigger AND s.event_type = 'click' AND s.value > 1""",
}


def excluded(day: str, alias: str = "c") -> str:
    """SQL test: a date expression is a weekend or listed day of the config."""
    return (
        f"(({alias}.excl_weekends AND dayofweek({day}) IN (0, 6))"
        f" OR list_contains({alias}.excl_dates, strftime({day}, '%Y-%m-%d')))"
    )


def local(ts: str, tz: str) -> str:
    """Naive UTC timestamp to naive local time."""
    return f"timezone({tz}, timezone('UTC', {ts}))"


def utc(local_ts: str, tz: str) -> str:
    """Naive local time to naive UTC: the offset in force at (local - offset at local read as UTC)."""
    first = f"({local_ts} - ({local(local_ts, tz)} - {local_ts}))"
    return f"({local_ts} - ({local(first, tz)} - {first}))"


# Hits that may take the lock of a run: no calendar excludes them and the pipeline is not observation-only.
VIEWS["live"] = f"SELECT h.* FROM hits h WHERE NOT dry_run AND NOT {excluded(local('h.ts', 'h.tz'), 'h')}"


def expand(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix the statement with the views it uses, directly or through other views."""
    known = {**VIEWS, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text, re.I):
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in needed) + "\n" + sql
