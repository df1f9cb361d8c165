"""Run states, run logs, and the replay of evaluation and polling over recorded history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipway.functions import values as V
from slipway.functions.ordered import HOUR_MS, as_of
from slipway.operators import sla as L
from slipway.operators.clean import run_plan
from slipway.operators.rules import evaluate
from slipway.schema import RUN_KEY
from slipway.session import staged

# Provider state -> (run state, failure category).
STATE_TABLE = {
    "glue": {"SUCCEEDED": ("succeeded", None), "TIMEOUT": ("failed", "TIMEOUT"), "FAILED": ("failed", "TRANSIENT"),
             "STOPPED": ("failed", "TRANSIENT"), "ERROR": ("failed", "TRANSIENT")},
    "emr": {"COMPLETED": ("succeeded", None), "FAILED": ("failed", "TRANSIENT"),
            "CANCELLED": ("failed", "TRANSIENT"), "INTERRUPTED": ("failed", "TRANSIENT")},
    "emr-serverless": {"SUCCESS": ("succeeded", None), "FAILED": ("failed", "TRANSIENT"),
                       "CANCELLED": ("failed", "TRANSIENT")},
    "step-function": {"SUCCEEDED": ("succeeded", None), "FAILED": ("failed", "TRANSIENT"),
                      "ABORTED": ("failed", "TRANSIENT"), "TIMED_OUT": ("failed", "TIMEOUT")},
    "databricks": {"TERMINATED": ("failed", "TRANSIENT"), "TERMINATED/SUCCESS": ("succeeded", None),
                   "SKIPPED": ("failed", "PERMANENT"), "INTERNAL_ERROR": ("failed", "TRANSIENT")},
    "airflow": {"success": ("succeeded", None), "failed": ("failed", None)},
    "command": {}, "http": {}, "lambda": {},
}
FAILURE_RECORD = "GlueExceptionAnalysisJobFailed"
POLL_TERMINAL = ["success", "fail", "timeout"]


def normalise_states(states: DataFrame) -> DataFrame:
    """Add ``run_state``, ``failure_category``, ``state_message`` and ``state_error`` to (job_type, state, result_state).

    Unlisted states and missing run ids are running; an unknown job type is an error. The mapping is a fixed
    literal, so no join is needed.
    """
    pairs = [(f"{t}|{s}", v) for t, m in STATE_TABLE.items() for s, v in m.items()]
    lookup = F.create_map(*[x for k, (state, cat) in pairs for x in (
        F.lit(k), F.struct(F.lit(state).alias("s"), F.lit(cat).cast("string").alias("c")))])
    result = F.coalesce("result_state", F.lit(""))
    exact = F.concat("job_type", F.lit("|"), "state", F.when(
        (F.col("state") == "TERMINATED") & (result == "SUCCESS"), F.lit("/SUCCESS")).otherwise(F.lit("")))
    hit = F.try_element_at(lookup, F.when(F.col("run_id").isNotNull(), exact))
    known = F.col("job_type").isin(*STATE_TABLE)
    return states.withColumn("_m", hit).withColumns({
        "run_state": F.when(known, F.coalesce("_m.s", F.lit("running"))),
        "failure_category": F.when(known, F.col("_m.c")),
        "state_message": F.when(result != "", F.concat_ws("/", "state", "result_state")).otherwise(F.col("state")),
        "state_error": F.when(~known, F.lit("unknown trigger type")),
    }).drop("_m")


def false_successes(states: DataFrame, logs: DataFrame) -> DataFrame:
    """Turn succeeded runs of the log-checked type into failures when their logs show one.

    The analysis stream is decisive; else the first driver line with an ERROR or FATAL severity mark, cut to 200
    bytes. Log lines are filtered before they are grouped.
    """
    m, marker = F.col("message"), '"Failure Reason":"'
    rca = (F.col("stream") == "analysis") & m.contains(FAILURE_RECORD)
    driver = (F.col("stream") == "driver") & (m.contains(" ERROR ") | m.contains(" FATAL "))
    evidence = logs.filter(rca | driver).groupBy("run_id").agg(
        F.min_by(F.when(rca, m), F.when(rca, F.col("seq"))).alias("_rca"),
        F.min_by(F.when(driver, V.first_bytes(m, 200)), F.when(driver, F.col("seq"))).alias("_drv"))
    reason = F.regexp_extract("_rca", f'{marker}([^"]*)"', 1)
    why = F.when(F.col("_rca").isNotNull(), F.concat(F.lit("RCA: "), F.when(reason != "", reason).otherwise("JobFailed"))) \
        .otherwise(F.concat(F.lit("driver log: "), F.col("_drv")))
    j = states.join(evidence, "run_id", "left")
    lied = (F.col("job_type") == "glue") & (F.col("run_state") == "succeeded") & why.isNotNull()
    return j.withColumns({
        "state_message": F.when(lied, F.concat(F.lit("SUCCEEDED ("), why, F.lit(")"))).otherwise(F.col("state_message")),
        "failure_category": F.when(lied, "TRANSIENT").otherwise(F.col("failure_category")),
        "run_state": F.when(lied, "failed").otherwise(F.col("run_state")),
    }).drop("_rca", "_drv")


def classify_failures(rows: DataFrame, *, message: str = "error", out: str = "failure_category") -> DataFrame:
    """TIMEOUT, PERMANENT (client errors) or TRANSIENT from failure text; no failure gives NULL."""
    m = F.col(message)
    timeout = m.contains("deadline exceeded") | m.contains("context deadline")
    return rows.withColumn(out, F.when(m.isNull(), None).when(timeout, "TIMEOUT").when(m.contains("status 4"), "PERMANENT")
                           .otherwise("TRANSIENT"))


def poll_outcomes(latest: DataFrame, polled: DataFrame) -> DataFrame:
    """Outcome per run: a terminal job event wins, else the polled state; NULL keeps polling.

    ``write_event`` marks outcomes that come from polling and still have to be written to the job log.
    """
    j = latest.join(polled.select(*RUN_KEY, "run_state", F.col("failure_category").alias("polled_category")), RUN_KEY,
                    "left")
    logged = F.when(F.col("event").isin(*POLL_TERMINAL), F.col("event"))
    polled_event = F.when(F.col("run_state") == "succeeded", "success").when(F.col("run_state") == "failed", "fail")
    outcome = F.coalesce(logged, polled_event)
    fresh_fail = logged.isNull() & (outcome == "fail")
    return j.withColumns({
        "outcome": outcome, "write_event": F.coalesce(logged.isNull() & outcome.isNotNull(), F.lit(False)),
        "category": F.when(fresh_fail, F.col("polled_category")),
        "event_type": F.when(fresh_fail, F.lit("JOB_FAILED"))})


def completion_transitions(outcomes: DataFrame, *, outcome: str = "outcome") -> DataFrame:
    """Status change of each finished run: success completes it, anything else fails it for good."""
    return outcomes.filter(F.col(outcome).isNotNull()).select(
        *RUN_KEY, F.lit("set").alias("action"),
        F.when(F.col(outcome) == "success", "COMPLETED").otherwise("FAILED_FINAL").alias("status"))


def _rules(configs: DataFrame) -> DataFrame:
    return configs.select("pipeline_id", F.col("cfg.validation.trigger").alias("_mode"),
                          F.col("cfg.validation.rules").alias("_rules"))


def _passes(n_passed: Column) -> Column:
    """The verdict from a count of passed rules, their mode ``_mode`` and number ``_n``."""
    any_mode = F.upper(F.coalesce("_mode", F.lit(""))) == "ANY"
    return F.when(any_mode, n_passed > 0).otherwise(n_passed == F.col("_n"))


def _tick_counts(ticks: DataFrame, rules: DataFrame, sensor_log: DataFrame, bucket_ms: int) -> DataFrame:
    """``n_passed`` of each (run, tick_ms) for which any rule's sensor was there.

    Each rule asks for the three spellings of its key that exist at all; the as-of lookup is one linear union,
    and only (position, priority, verdict) leave it. Verdicts are dealt out by (run, tick) once, which serves both steps
    of the count.
    """
    compact = F.replace("exec_date", F.lit("-"), F.lit(""))
    key = F.col("rule.key")
    asked = ticks.select(*RUN_KEY, "tick_ms").join(rules.select("pipeline_id", F.posexplode("_rules").alias("pos", "rule")),
                                                  "pipeline_id")
    asked = asked.select(*RUN_KEY, "tick_ms", "pos", "rule", F.posexplode(F.array(
        F.concat(key, F.lit("#"), "exec_date"), F.concat(key, F.lit("#"), compact), key)).alias("_p", "sensor_key"))
    asked = asked.join(sensor_log.select("pipeline_id", "sensor_key").distinct(), ["pipeline_id", "sensor_key"],
                       "left_semi")
    hit = as_of(asked, sensor_log, ["pipeline_id", "sensor_key"], probe_ms="tick_ms", fact_ms="ts_ms",
                fact_order=["seq"], payload=["data"], out="_s", bucket_ms=bucket_ms)
    found = hit.filter(F.col("_s").isNotNull()).withColumn("data", F.col("_s.data")).drop("_s")
    verdicts = evaluate(found, now=F.timestamp_millis("tick_ms")).select(*RUN_KEY, "tick_ms", "pos", "_p", "passed")
    best = verdicts.repartition(*RUN_KEY, "tick_ms").groupBy(*RUN_KEY, "tick_ms", "pos").agg(
        F.min_by("passed", "_p").alias("passed"))
    return best.groupBy(*RUN_KEY, "tick_ms").agg(F.count_if("passed").alias("n_passed"))


def evaluate_ticks(ticks: DataFrame, configs: DataFrame, sensor_log: DataFrame, *, bucket_ms: int = HOUR_MS
                   ) -> DataFrame:
    """Rule verdict of each (run, tick_ms) on the sensor history up to that moment: adds ``passed``, ``n_passed``."""
    rules = _rules(configs)
    sized = ticks.join(rules.select("pipeline_id", "_mode", F.size("_rules").alias("_n")), "pipeline_id")
    counts = _tick_counts(ticks, rules, sensor_log, bucket_ms)
    out = sized.join(counts, [*RUN_KEY, "tick_ms"], "left").withColumn("n_passed", F.coalesce("n_passed", F.lit(0)))
    return out.withColumn("passed", _passes(F.col("n_passed"))).withColumnRenamed("_n", "n_rules").drop("_mode")


def readiness_replay(runs: DataFrame, configs: DataFrame, sensor_log: DataFrame, *, start_ms: str = "start_ms",
                     bucket_ms: int = HOUR_MS) -> DataFrame:
    """Evaluate each run at its start and every interval inside the window; first passing tick or exhausted.

    Only the ticks that pass come back to their run. A tick without any sensor passes where there are no rules and
    not one of them has to pass; then the first one does.
    """
    plan = run_plan(configs).select("pipeline_id", "eval_interval_s", "eval_window_s")
    n = F.greatest(F.lit(1), F.ceil(F.col("eval_window_s") / F.col("eval_interval_s"))).cast("bigint")
    planned = runs.select(*RUN_KEY, F.col(start_ms).alias("start_ms")).join(plan, "pipeline_id").select(
        *RUN_KEY, "start_ms", n.alias("n_ticks"), (F.col("eval_interval_s") * 1000).alias("_step"))
    ticks = planned.select(*RUN_KEY, "start_ms", "_step", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("n_ticks") - 1)).alias("tick"))
    ticks = ticks.withColumn("tick_ms", F.col("start_ms") + F.col("tick") * F.col("_step"))
    rules = _rules(configs)
    sizes = rules.select("pipeline_id", "_mode", F.size("_rules").alias("_n"))
    passing = _tick_counts(ticks, rules, sensor_log, bucket_ms).join(sizes, "pipeline_id").filter(
        _passes(F.col("n_passed"))).select(*RUN_KEY, "tick_ms")
    unruled = sizes.filter(_passes(F.lit(0))).select("pipeline_id", F.lit(0).cast("bigint").alias("_free")).distinct()
    past = F.col("tick_ms") - F.col("start_ms")
    at = F.when((past >= 0) & (past % F.col("_step") == 0) & (past < F.col("n_ticks") * F.col("_step")),
                F.floor(past / F.col("_step")))
    done = planned.join(passing, RUN_KEY, "left").join(unruled, "pipeline_id", "left").withColumn(
        "tick", F.coalesce("_free", at))
    first = done.groupBy(*RUN_KEY, "start_ms", "n_ticks").agg(
        F.min("tick").alias("tick"), F.min(F.col("start_ms") + F.col("tick") * F.col("_step")).alias("passed_ms"))
    ok = F.col("tick").isNotNull()
    return first.withColumns({
        "status": F.when(ok, "passed").otherwise("exhausted"),
        "evaluations": F.coalesce(F.col("tick") + 1, F.col("n_ticks")),
        "event_type": F.when(ok, "VALIDATION_PASSED").otherwise("VALIDATION_EXHAUSTED")})


def _polls(runs: DataFrame, configs: DataFrame, start_ms: str) -> DataFrame:
    plan = run_plan(configs).select("pipeline_id", "poll_interval_s", "poll_window_s")
    return runs.select(*RUN_KEY, F.col(start_ms).alias("_start")).join(plan, "pipeline_id").withColumn(
        "n_polls", F.greatest(F.lit(1), F.ceil(F.col("poll_window_s") / F.col("poll_interval_s"))).cast("bigint"))


def visible_events(runs: DataFrame, configs: DataFrame, job_log: DataFrame, *, start_ms: str = "passed_ms") -> DataFrame:
    """Job events that some poll of their run can see: the last of every (run, polling slot) inside the window."""
    e = job_log.select(*RUN_KEY, "event_ms", "seq", "event")
    slot = F.greatest(F.lit(1), F.ceil((F.col("event_ms") - F.col("_start")) / (F.col("poll_interval_s") * 1000)))
    seen = _polls(runs, configs, start_ms).join(e, RUN_KEY).withColumn("poll", slot.cast("bigint")).filter(
        F.col("poll") <= F.col("n_polls"))
    return seen.groupBy(*RUN_KEY, "poll").agg(F.max(F.struct("event_ms", "seq", "event")).alias("e")).select(
        *RUN_KEY, "e.event_ms", "e.seq", "e.event")


def poll_replay(runs: DataFrame, configs: DataFrame, job_log: DataFrame, *, start_ms: str = "passed_ms") -> DataFrame:
    """First poll that sees a terminal latest event; a timeout when the window closes first.

    Polls happen at start + k intervals. Only the last event of each polling slot can be seen, so events are
    reduced to one per (run, slot) and no poll rows are generated.
    """
    r = _polls(runs, configs, start_ms)
    e = job_log.select(*RUN_KEY, "event_ms", F.col("seq").alias("_seq"), "event")
    slot = F.greatest(F.lit(1), F.ceil((F.col("event_ms") - F.col("_start")) / (F.col("poll_interval_s") * 1000)))
    seen = r.join(e, RUN_KEY).withColumn("poll", slot.cast("bigint")).filter(F.col("poll") <= F.col("n_polls"))
    last = seen.groupBy(*RUN_KEY, "poll").agg(F.max_by("event", F.struct("event_ms", "_seq")).alias("event"))
    hit = last.filter(F.col("event").isin(*POLL_TERMINAL)).groupBy(*RUN_KEY).agg(
        F.min_by("event", "poll").alias("event"), F.min("poll").alias("poll"))
    out = r.join(hit, RUN_KEY, "left")
    polls = F.coalesce("poll", "n_polls")
    return out.select(
        *RUN_KEY, polls.alias("polls"), F.coalesce("event", F.lit("timeout")).alias("outcome"),
        F.col("event").isNull().alias("poll_exhausted"),
        (F.col("_start") + polls * F.col("poll_interval_s") * 1000).alias("finished_ms"),
        F.when(F.col("event").isNull(), F.lit("JOB_POLL_EXHAUSTED")).alias("event_type"))


def exhaustion_rows(replayed: DataFrame, polled: DataFrame, failed_starts: DataFrame) -> DataFrame:
    """Job-log rows and events of runs that ran out of evaluations, polls or start attempts.

    ``failed_starts``: run key, ``at_ms`` and ``error``; their lock is released so the run can start again.
    """
    def rows(df: DataFrame, job_event: str, event: str, at: Column, message: Column, release: bool) -> DataFrame:
        return df.select(*RUN_KEY, at.alias("event_ms"), F.lit(job_event).alias("event"), message.alias("error"),
                         F.lit(event).alias("event_type"), F.lit(release).alias("release_lock"))

    validation = rows(replayed.filter(F.col("status") == "exhausted"), "validation-exhausted", "VALIDATION_EXHAUSTED",
                      F.col("start_ms"), F.lit("evaluation window exhausted without passing"), False)
    polls = rows(polled.filter("poll_exhausted"), "job-poll-exhausted", "JOB_POLL_EXHAUSTED", F.col("finished_ms"),
                 F.lit("job poll window exhausted"), False)
    starts = rows(failed_starts, "infra-trigger-exhausted", "RETRY_EXHAUSTED", F.col("at_ms"), F.col("error"), True)
    return validation.unionByName(polls).unionByName(starts)


def run_outcomes(runs: DataFrame, configs: DataFrame, sensor_log: DataFrame, job_log: DataFrame, *,
                 start_ms: str = "start_ms") -> DataFrame:
    """Final state of every run: readiness replay, poll replay, completion status and SLA verdict.

    A run whose validation is exhausted keeps its RUNNING row until it goes stale. The verdict compares the end of
    the run with the deadline planned at its start.
    """
    # One narrow row per run, read twice below: stored once instead of being replayed twice.
    ready = staged(readiness_replay(runs, configs, sensor_log, start_ms=start_ms), "readiness")
    polled = poll_replay(ready.filter(F.col("status") == "passed"), configs, job_log)
    j = ready.select(*RUN_KEY, "start_ms", "passed_ms", F.col("status").alias("validation")).join(
        polled.select(*RUN_KEY, "outcome", "poll_exhausted", "polls", "finished_ms"), RUN_KEY, "left")
    status = F.when(F.col("outcome").isNull(), "RUNNING").when(F.col("outcome") == "success", "COMPLETED").otherwise(
        "FAILED_FINAL")
    j = j.withColumn("final_status", status)
    c = F.col("cfg")["sla"]
    texts = configs.select(
        "pipeline_id", c.isNotNull().alias("_has_sla"), c["deadline"].alias("deadline"),
        c["expectedDuration"].alias("expected_duration"), c["timezone"].alias("sla_timezone"))
    d = L.absolute_deadline(j.join(texts, "pipeline_id"), now=F.timestamp_millis("start_ms"))
    end = F.timestamp_millis("finished_ms")
    verdict = F.when(F.col("_has_sla") & F.col("finished_ms").isNotNull() & F.col("breach_at").isNotNull(),
                     F.when(end >= F.col("breach_at"), "SLA_BREACH").otherwise("SLA_MET"))
    return d.select(*RUN_KEY, "start_ms", "validation", "passed_ms", "outcome", "poll_exhausted", "polls", "finished_ms",
                    "final_status", verdict.alias("sla_verdict"))


