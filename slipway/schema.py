"""Table schemas of the control plane."""

from __future__ import annotations

RULE = "STRUCT<key: STRING, check: STRING, field: STRING, value: VARIANT>"

# The pipeline configuration document.
CONFIG_DDL = f"""
    pipeline STRUCT<id: STRING, owner: STRING, description: STRING>,
    schedule STRUCT<
        cron: STRING, timezone: STRING,
        trigger: STRUCT<key: STRING, check: STRING, field: STRING, value: VARIANT, deadline: STRING>,
        exclude: STRUCT<weekends: BOOLEAN, holidays: STRING, dates: ARRAY<STRING>>,
        include: STRUCT<dates: ARRAY<STRING>>,
        calendar: STRING, time: STRING,
        evaluation: STRUCT<window: STRING, interval: STRING>>,
    sla STRUCT<deadline: STRING, expectedDuration: STRING, maxDuration: STRING, timezone: STRING, critical: BOOLEAN>,
    validation STRUCT<trigger: STRING, rules: ARRAY<{RULE}>>,
    job STRUCT<
        type: STRING, config: MAP<STRING, VARIANT>, maxRetries: INT, jobPollWindowSeconds: INT,
        maxDriftReruns: INT, maxManualReruns: INT, maxCodeRetries: INT>,
    postRun STRUCT<rules: ARRAY<{RULE}>, sensorTimeout: STRING, driftThreshold: DOUBLE, driftField: STRING>,
    dryRun BOOLEAN
"""
CONFIG_STRUCT = f"STRUCT<{CONFIG_DDL}>"

CALENDAR_DDL = "name STRING, days ARRAY<STRING>, dates ARRAY<STRING>"

RUN_KEY = ["pipeline_id", "schedule_id", "exec_date"]

# Job events that end a run.
TERMINAL_EVENTS = [
    "success", "fail", "timeout", "infra-trigger-exhausted", "validation-exhausted", "job-poll-exhausted",
]
FINISHED = ["COMPLETED", "FAILED_FINAL"]
LOCK_SECONDS = 4 * 3600 + 30 * 60  # run timeout of 4 h plus 30 min
RUN_TIMEOUT_SECONDS = 4 * 3600

#: Bounds of whole-number settings of a job. Poll windows may also be 0.
JOB_BOUNDS = {
    "maxRetries": (0, 10), "maxDriftReruns": (0, 5), "maxManualReruns": (0, 5), "maxCodeRetries": (0, 3),
    "jobPollWindowSeconds": (60, 86400),
}
