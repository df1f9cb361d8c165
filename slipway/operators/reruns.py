"""Rerun, retry and late-data decisions.

Requests of one run compete for budgets in time order. The order effects reduce to bounded facts about the run,
so no per-run loop and no sort of a whole run is needed:

* a request is stopped by the circuit breaker only when the latest job event is an unchanged success and the
  request is the first one to write an event after it: a minimum per (run, job event);
* the accepted requests of a class are the first ``budget - prior`` that pass the breaker. Valid budgets are at most
  5 (retries at most 10), so they are a top-k per group, which Spark limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from slipway.functions import values as V, zones as Z
from slipway.functions.ordered import MINUTE_MS, as_of, earliest_by, running_before
from slipway.operators.rules import valid_configs
from slipway.operators.sla import latest_job_events
from slipway.schema import JOB_BOUNDS, RUN_KEY
from slipway.session import staged

DRIFT_REASONS = ["data-drift", "late-data"]
RETRY_REASON = "job-fail-retry"
MAX_RETRIES = max(JOB_BOUNDS[k][1] for k in ("maxRetries", "maxCodeRetries"))  # valid configs keep the bounds


def sensor_update_summary(sensors: DataFrame) -> DataFrame:
    """Per pipeline: sensor count, how many carry ``updatedAt``, and the latest usable one in milliseconds."""
    name = F.lit("updatedAt")
    return sensors.groupBy("pipeline_id").agg(
        F.count("*").alias("n_sensors"), F.count_if(V.has_field(F.col("data"), name)).alias("n_updated"),
        F.max(V.epoch_ms_value(V.field(F.col("data"), name))).alias("max_updated_ms"))


def _fresh(job_ms: Column) -> Column:
    return (
        job_ms.isNull() | F.col("n_sensors").isNull() | (F.col("n_updated") == 0)
        | F.coalesce(F.col("max_updated_ms") > job_ms, F.lit(False)))


def freshness(runs: DataFrame, sensors: DataFrame, *, job_ms: str = "event_ms") -> DataFrame:
    """Add ``fresh``: some sensor of the pipeline changed after the job event, or nothing can tell."""
    summary = sensor_update_summary(sensors)
    out = runs.join(summary, "pipeline_id", "left").withColumn("fresh", _fresh(F.col(job_ms)))
    return out.drop("n_sensors", "n_updated", "max_updated_ms")


def count_reruns(reruns: DataFrame, reasons: list[str] | None = None) -> DataFrame:
    """Reruns per run: all of them, or those of a reason set (an empty set counts none)."""
    hit = F.lit(True) if reasons is None else (F.col("reason").isin(*reasons) if reasons else F.lit(False))
    return reruns.groupBy(*RUN_KEY).agg(F.count_if(hit).alias("n"))


def rerun_counts(reruns: DataFrame, reasons: dict[str, list[str] | None]) -> DataFrame:
    """Reruns per run, one count for each named reason set (None: all), in one pass."""
    def hit(names: list[str] | None) -> Column:
        return F.lit(True) if names is None else F.col("reason").isin(*names) if names else F.lit(False)

    return reruns.groupBy(*RUN_KEY).agg(*[F.count_if(hit(names)).alias(n) for n, names in reasons.items()])


def rerun_class(reason: Column) -> Column:
    return F.when(reason.isin(*DRIFT_REASONS), "drift").otherwise(reason)


def _prepared(requests: DataFrame, configs: DataFrame, reruns: DataFrame, job_log: DataFrame, summary: DataFrame, *,
              observe: bool) -> DataFrame:
    """Requests with class, budget, prior counts, the job event as of the request, and freshness."""
    c = F.col("cfg")
    reason = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("manual"))
    q = requests.withColumn("reason", reason).join(valid_configs(configs), "pipeline_id").filter(
        F.coalesce(c["dryRun"], F.lit(False)) == observe).select(
        *RUN_KEY, "requested_ms", "seq", "reason", rerun_class(F.col("reason")).alias("class"),
        Z.excluded_date(c, F.col("exec_date")).alias("excluded"),
        F.when(rerun_class(F.col("reason")) == "drift", F.coalesce(c["job"]["maxDriftReruns"], F.lit(1)))
        .otherwise(F.coalesce(c["job"]["maxManualReruns"], F.lit(1))).cast("bigint").alias("budget"))
    prior = reruns.groupBy(*RUN_KEY, rerun_class(F.col("reason")).alias("class")).agg(F.count("*").alias("prior"))
    total = reruns.groupBy(*RUN_KEY).agg(F.count("*").alias("prior_all"))
    q = as_of(q, job_log, RUN_KEY, probe_ms="requested_ms", fact_ms="event_ms", fact_order=["seq"],
              payload=["event", "event_ms"], out="job", bucket_ms=MINUTE_MS)
    q = q.join(prior, [*RUN_KEY, "class"], "left").join(total, RUN_KEY, "left").join(
        summary, "pipeline_id", "left")
    unchanged = (F.col("job.event") == "success") & ~_fresh(F.col("job.event_ms"))
    return q.withColumns({
        "prior": F.coalesce("prior", F.lit(0)), "prior_all": F.coalesce("prior_all", F.lit(0)),
        "unchanged_success": F.coalesce(unchanged, F.lit(False)),
    }).drop("n_sensors", "n_updated", "max_updated_ms")


def rerun_decisions(requests: DataFrame, configs: DataFrame, reruns: DataFrame, job_log: DataFrame,
                    triggers: DataFrame, sensors: DataFrame) -> DataFrame:
    """``decide_reruns`` with the sensors' update summary taken from their whole table."""
    return decide_reruns(requests, configs, reruns, job_log, triggers, sensor_update_summary(sensors))


def decide_reruns(requests: DataFrame, configs: DataFrame, reruns: DataFrame, job_log: DataFrame, triggers: DataFrame,
                  summary: DataFrame) -> DataFrame:
    """One decision per request: excluded, rejected (limit or breaker), infra_failure (no lock row) or accepted.

    Only valid, non-observation configs decide; others give no row. ``seq`` must be unique within a run.
    ``attempt`` numbers accepted reruns after all earlier ones. The prepared requests are written once, since three
    steps read them.
    """
    q = _prepared(requests, configs, reruns, job_log, summary, observe=False).join(
        triggers.select(*RUN_KEY, F.lit(True).alias("_lock")), RUN_KEY, "left")
    q = q.withColumns({
        "has_lock": F.coalesce("_lock", F.lit(False)),
        "job_ms": F.coalesce("job.event_ms", F.lit(-1)),
        "room": F.greatest(F.col("budget") - F.col("prior"), F.lit(0)),
        "at": F.struct("requested_ms", "reason", "seq"),
    }).drop("_lock", "job")
    q = staged(q, "rerun-requests")
    writes = F.col("has_lock") | (F.col("room") == 0) | F.col("unchanged_success")
    first = q.filter(writes).groupBy(*RUN_KEY, "job_ms").agg(F.min("at").alias("_first"))
    q = q.join(first, [*RUN_KEY, "job_ms"], "left").withColumn(
        "breaker", F.col("unchanged_success") & (F.col("at") == F.col("_first")))
    # Of the requests of a class that nothing else stops, the first ``room`` are accepted.
    stands = ~F.col("breaker") & F.col("has_lock") & ~F.col("excluded") & (F.col("room") > 0)
    q = running_before(q, [*RUN_KEY, "class"], "requested_ms", ["reason", "seq"], {"_ahead": stands}, bucket_ms=MINUTE_MS)
    q = running_before(q, RUN_KEY, "requested_ms", ["reason", "seq"],
                       {"_earlier": stands & (F.col("_ahead") < F.col("room"))}, bucket_ms=MINUTE_MS)
    over = (F.col("prior") >= F.col("budget")) | (F.col("has_lock") & (F.col("_ahead") >= F.col("room")))
    decision = (
        F.when(F.col("excluded"), "excluded").when(over, "rejected").when(F.col("breaker"), "rejected")
        .when(~F.col("has_lock"), "infra_failure").otherwise("accepted"))
    label = F.when(F.col("class") == "drift", "drift rerun limit exceeded").otherwise("manual rerun limit exceeded")
    why = (
        F.when(F.col("excluded"), "excluded by calendar").when(over, label)
        .when(F.col("breaker"), "previous run succeeded and no sensor data has changed"))
    d = F.col("decision")
    event = (
        F.when(d == "excluded", "PIPELINE_EXCLUDED").when(d == "rejected", "RERUN_REJECTED")
        .when(d == "infra_failure", "INFRA_FAILURE").otherwise("RERUN_ACCEPTED"))
    return q.withColumns({"decision": decision, "reject_reason": why}).select(
        *RUN_KEY, "requested_ms", "seq", "reason", "budget", "decision", "reject_reason", event.alias("event_type"),
        F.when(d == "accepted", F.col("prior_all") + F.col("_earlier")).alias("attempt"))


def observed_rerun_decisions(requests: DataFrame, configs: DataFrame, reruns: DataFrame, job_log: DataFrame,
                             sensors: DataFrame) -> DataFrame:
    """What observation-only pipelines would decide; nothing is written, so requests do not affect each other."""
    q = _prepared(requests, configs, reruns, job_log, sensor_update_summary(sensors), observe=True)
    over = F.col("prior") >= F.col("budget")
    rejected = F.col("excluded") | over | F.col("unchanged_success")
    return q.select(
        *RUN_KEY, "requested_ms", "seq", "reason", F.col("prior").alias("rerun_count"), "budget",
        F.when(rejected, "DRY_RUN_RERUN_REJECTED").otherwise("DRY_RUN_WOULD_RERUN").alias("event_type"),
        F.when(F.col("excluded"), "excluded by calendar").when(over, "limit exceeded")
        .when(F.col("unchanged_success"), "circuit breaker").alias("reject_reason"),
        F.when(F.col("excluded") | over, None).when(F.col("job").isNull(), "skipped (no job history)")
        .when(F.col("unchanged_success"), "rejected").otherwise("passed").alias("circuit_breaker"))


def route_job_events(job_log: DataFrame) -> DataFrame:
    """Add ``route``: failure, completed, ignored, or missing when there is no event."""
    e = F.col("event")
    return job_log.withColumns({
        "route": F.when(e.isNull(), "missing").when(e.isin("fail", "timeout"), "failure")
        .when(e == "success", "completed").otherwise("ignored"),
        "event_type": F.when(e == "success", F.lit("JOB_COMPLETED"))})


def retries_used(reruns: DataFrame) -> DataFrame:
    """Retries per run so far: ``prior``."""
    return reruns.filter(F.col("reason") == RETRY_REASON).groupBy(*RUN_KEY).agg(F.count("*").alias("prior"))


def _retry_inputs(job_log: DataFrame, configs: DataFrame, prior: DataFrame, *, observe: bool) -> DataFrame:
    c = F.col("cfg")["job"]
    failures = job_log.filter(F.col("event").isin("fail", "timeout"))
    permanent = F.coalesce(F.col("category") == "PERMANENT", F.lit(False))
    cfg = valid_configs(configs).filter(F.coalesce("cfg.dryRun", F.lit(False)) == observe)
    q = failures.join(cfg, "pipeline_id").select(
        *RUN_KEY, "event_ms", "seq", "event", "category",
        Z.excluded_date(F.col("cfg"), F.col("exec_date")).alias("excluded"),
        F.coalesce(c["maxRetries"], F.lit(0)).cast("bigint").alias("_retries"),
        F.coalesce(c["maxCodeRetries"], F.lit(1)).cast("bigint").alias("_code"), permanent.alias("_permanent"))
    return q.join(prior.select(*RUN_KEY, "prior"), RUN_KEY, "left").withColumns({
        "prior": F.coalesce("prior", F.lit(0)),
        "max_retries": F.when(F.col("_permanent"), F.col("_code")).otherwise(F.col("_retries"))})


def retry_decisions(job_log: DataFrame, configs: DataFrame, reruns: DataFrame, triggers: DataFrame) -> DataFrame:
    """``decide_retries`` with the retries counted in the whole table of reruns."""
    return decide_retries(job_log, configs, retries_used(reruns), triggers)


def decide_retries(job_log: DataFrame, configs: DataFrame, used: DataFrame, triggers: DataFrame) -> DataFrame:
    """One decision per failure: exhausted, excluded, retry, or retry_without_lock (budget used, nothing started).

    A run has two limits (by failure category). Until the smaller one is reached every failure is retried; after
    that only failures with the larger limit are, until it is reached too. Both lists are bounded top-k per run.
    """
    q = _retry_inputs(job_log, configs, used, observe=False)
    q = q.withColumns({"_low": F.least("_retries", "_code"), "_high": F.greatest("_retries", "_code"),
                       "at": F.struct("event_ms", "seq")})
    q = q.withColumn("_free", F.greatest(F.col("_low") - F.col("prior"), F.lit(0)).cast("int"))
    w = W.partitionBy(*RUN_KEY).orderBy("at")

    def first_of(rows: DataFrame, k: int, out: str) -> DataFrame:
        top = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
        return top.groupBy(*RUN_KEY).agg(F.sort_array(F.collect_list("at")).alias(out))

    spare = q.filter(~F.col("excluded") & (F.col("prior") < F.col("_high")))
    any_kind = first_of(spare, MAX_RETRIES, "_any")
    large = first_of(spare.filter(F.col("max_retries") == F.col("_high")), 2 * MAX_RETRIES, "_large")
    q = q.join(any_kind, RUN_KEY, "left").join(large, RUN_KEY, "left")
    none = F.array().cast("array<struct<event_ms:bigint,seq:bigint>>")
    free = F.slice(F.coalesce("_any", none), F.lit(1), F.col("_free"))
    extra = F.greatest(F.col("_high") - F.col("prior") - F.size(free), F.lit(0)).cast("int")
    later = F.slice(F.array_except(F.coalesce("_large", none), free), F.lit(1), extra)
    q = q.withColumn("_retried", F.concat(free, later))
    before = F.size(F.filter("_retried", lambda x: x < F.col("at")))
    count = F.when(F.col("excluded"), F.col("prior")).otherwise(F.col("prior") + before)
    q = q.withColumn("rerun_count", count).join(
        triggers.select(*RUN_KEY, F.lit(True).alias("_lock")), RUN_KEY, "left")
    decision = (
        F.when(F.col("rerun_count") >= F.col("max_retries"), "exhausted").when(F.col("excluded"), "excluded")
        .when(F.col("_lock").isNull(), "retry_without_lock").otherwise("retry"))
    return q.select(
        *RUN_KEY, "event_ms", "seq", "event", "category", "rerun_count", "max_retries", decision.alias("decision"),
        F.when(decision == "exhausted", "RETRY_EXHAUSTED").when(decision == "excluded", "PIPELINE_EXCLUDED")
        .alias("event_type"),
        F.when(decision.isin("exhausted", "excluded"), F.lit("FAILED_FINAL")).alias("new_status"))


def observed_retry_decisions(job_log: DataFrame, configs: DataFrame, reruns: DataFrame) -> DataFrame:
    """What observation-only pipelines would decide on each failure."""
    q = _retry_inputs(job_log, configs, retries_used(reruns), observe=True)
    spent = (F.col("prior") >= F.col("max_retries")) | F.col("excluded")
    return q.select(
        *RUN_KEY, "event_ms", "seq", F.col("prior").alias("retries"), "max_retries",
        F.when(spent, "DRY_RUN_RETRY_EXHAUSTED").otherwise("DRY_RUN_WOULD_RETRY").alias("event_type"),
        F.when((F.col("prior") < F.col("max_retries")) & F.col("excluded"), F.lit("excluded by calendar")).alias("reason"))


def late_data(hits: DataFrame, triggers: DataFrame, job_log: DataFrame) -> DataFrame:
    """First qualifying sensor write after a completed, successful run: late data plus a rerun request.

    The job-log row it writes hides the success, so later writes of the same run are not reported again.
    """
    done = triggers.filter(F.col("status") == "COMPLETED").select(*RUN_KEY).join(
        latest_job_events(job_log.select(*RUN_KEY, "event_ms", "seq", "event")).filter(F.col("event") == "success")
        .select(*RUN_KEY, F.col("event_ms").alias("completed_ms")), RUN_KEY)
    late = hits.select(*RUN_KEY, "ts_ms", "seq", "sensor_key").join(done, RUN_KEY).filter(
        F.col("ts_ms") > F.col("completed_ms"))
    first = earliest_by(late, RUN_KEY, ["ts_ms", "seq"], ["sensor_key", "completed_ms"])
    return first.withColumns({
        "event_type": F.lit("LATE_DATA_ARRIVAL"), "reason": F.lit("late-data"),
        "late_ms": F.col("ts_ms") - F.col("completed_ms")})
