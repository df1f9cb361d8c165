"""Scans, lookups, snapshots and sinks of the control, job-log, rerun and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slipway.functions.ordered import MINUTE_MS, earliest_by, latest_by, running_before
from slipway.functions.values import non_null_text
from slipway.schema import CALENDAR_DDL, CONFIG_DDL, LOCK_SECONDS, RUN_KEY

JOB_TTL_SECONDS = 30 * 86_400


# ---- configs and calendars -------------------------------------------------------------------------------

def scan_configs(control: DataFrame) -> DataFrame:
    """CONFIG rows parsed to ``cfg``; a row that does not parse has NULL ``cfg`` and an ``error``."""
    rows = control.filter((F.col("kind") == "config") & (F.col("sk") == "CONFIG")).select(
        F.regexp_replace("pk", "^PIPELINE#", "").alias("pipeline_id"), "config")
    parsed = rows.withColumn("cfg", F.from_json("config", CONFIG_DDL, {"mode": "PERMISSIVE"}))
    bad = F.col("config").isNull() | F.col("cfg").isNull() | F.col("cfg.pipeline").isNull()
    return parsed.select(
        "pipeline_id", F.when(~bad, F.col("cfg")).alias("cfg"), F.when(bad, "unparseable config").alias("error"))


def load_config_files(spark: SparkSession, path: str, *, one_per_file: bool = False) -> DataFrame:
    """Configs from a directory of JSON documents (one per line, or one per file); documents without ``pipeline.id`` are rejected with an error."""
    docs = spark.read.schema(CONFIG_DDL).option("multiLine", one_per_file).json(path)
    ok = non_null_text(F.col("pipeline.id"))
    return docs.select(
        F.col("pipeline.id").alias("pipeline_id"), F.struct(*docs.columns).alias("cfg"),
        F.when(~ok, "missing pipeline.id").alias("error"))


def load_calendars(spark: SparkSession, path: str, *, one_per_file: bool = False) -> DataFrame:
    """Named calendars; a calendar without a name is dropped to ``error``."""
    docs = spark.read.schema(CALENDAR_DDL).option("multiLine", one_per_file).json(path)
    return docs.withColumn("error", F.when(~non_null_text(F.col("name")), "missing name"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


# ---- scans and lookups -----------------------------------------------------------------------------------

def all_sensors(control: DataFrame) -> DataFrame:
    """SENSOR rows with their bare key (prefix filter reaches the scan)."""
    return control.filter((F.col("kind") == "sensor") & F.col("sk").startswith("SENSOR#")).select(
        F.regexp_replace("pk", "^PIPELINE#", "").alias("pipeline_id"),
        F.regexp_replace("sk", "^SENSOR#", "").alias("sensor_key"), "ts", "seq", "data")


def lookup(requests: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Point lookups for a whole table of requests; missing rows give NULL columns."""
    return requests.join(table, keys, "left")


def running_triggers(control: DataFrame) -> DataFrame:
    return control.filter(
        (F.col("kind") == "trigger") & F.col("sk").startswith("TRIGGER#") & (F.col("status") == "RUNNING"))


def has_trigger_for_date(dates: DataFrame, triggers: DataFrame) -> DataFrame:
    """Add ``found``: a trigger of the daily date itself or of any hour of that day exists.

    A prefix test on execution dates equals an equality test on their first characters, so each trigger offers
    its full date and its day, and the lookup is a plain equi-join.
    """
    t = triggers.select(
        "pipeline_id", "schedule_id",
        F.explode(F.array_distinct(F.array(F.col("exec_date"), F.split_part("exec_date", F.lit("T"), F.lit(1)))))
        .alias("exec_date"),
    ).distinct().withColumn("_hit", F.lit(True))
    return dates.join(t, RUN_KEY, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def route_changes(changes: DataFrame) -> DataFrame:
    """Add ``route`` from the sort key; rows without keys get ``error`` and never stop the batch."""
    sk = F.col("sk")
    route = F.when(sk.startswith("SENSOR#"), "sensor").when(sk.startswith("CONFIG"), "config") \
        .when(sk.startswith("JOB#"), "job").when(sk.startswith("RERUN_REQUEST#"), "rerun_request").otherwise("ignore")
    missing = ~non_null_text(F.col("pk")) | ~non_null_text(sk)
    return changes.withColumns({
        "route": F.when(~missing, route), "error": F.when(missing, F.lit("missing key")),
    })


# ---- snapshots -------------------------------------------------------------------------------------------

def latest_sensors(sensor_log: DataFrame, *, deleted: Column | None = None) -> DataFrame:
    """Current sensor rows: last write wins; rows whose last write is a delete are left out."""
    cols = [c for c in sensor_log.columns if c not in ("pipeline_id", "sensor_key", "ts_ms", "seq")]
    out = latest_by(sensor_log, ["pipeline_id", "sensor_key"], ["ts_ms", "seq"], cols)
    return out if deleted is None else out.filter(~deleted)


def insert_if_absent(candidates: DataFrame, existing: DataFrame, keys: list[str], order: list[str],
                     payload: list[str]) -> DataFrame:
    """First candidate per key among keys not present yet.

    Candidates are reduced to one row per key before they meet the existing rows.
    """
    return earliest_by(candidates, keys, order, payload).join(existing.select(*keys), keys, "left_anti")


def apply_transitions(triggers: DataFrame, transitions: DataFrame) -> DataFrame:
    """New trigger snapshot: conditional reset, status change and release.

    ``transitions``: run key, ``action`` (reset / set / release), ``status`` for set, ``at`` epoch seconds; at most
    one row per run. A reset needs an existing row; a terminal status drops the ttl; a release removes the row.
    """
    j = triggers.join(transitions.select(*RUN_KEY, "action", F.col("status").alias("_to"), "at"), RUN_KEY, "full")
    exists, act = F.col("status").isNotNull(), F.col("action")
    terminal = F.col("_to").isin("COMPLETED", "FAILED_FINAL")
    status = F.when(act == "reset", "RUNNING").when(act == "set", F.col("_to")).otherwise(F.col("status"))
    ttl = (
        F.when(act == "reset", F.col("at") + LOCK_SECONDS)
        .when((act == "set") & terminal, F.lit(None))
        .otherwise(F.col("ttl_epoch"))
    )
    keep = (exists & (F.coalesce(act, F.lit("")) != "release")) | (~exists & (act == "set"))
    return j.filter(keep).select(*RUN_KEY, status.alias("status"), ttl.cast("bigint").alias("ttl_epoch"))


def number_reruns(new: DataFrame, existing: DataFrame, *, bucket_ms: int = MINUTE_MS) -> DataFrame:
    """Append-ready reruns with the 0-based attempt = count of all earlier reruns of the run, any reason."""
    prior = existing.groupBy(*RUN_KEY).agg(F.count("*").alias("_prior"))
    ranked = running_before(new, RUN_KEY, "triggered_ms", ["reason", "seq"], {"_rank": F.lit(1)}, bucket_ms=bucket_ms)
    return ranked.join(prior, RUN_KEY, "left").withColumn(
        "attempt", F.coalesce("_prior", F.lit(0)) + F.col("_rank")).drop("_prior", "_rank")


# ---- append logs and retention ---------------------------------------------------------------------------

def job_log_rows(events: DataFrame, *, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Job-log rows with composite keys; empty optional columns are NULL; kept 30 days after the event.

    ``keep`` names columns that go along as they are.
    """
    return events.select(
        *keep,
        F.concat(F.lit("PIPELINE#"), "pipeline_id").alias("pk"),
        F.concat_ws("#", F.lit("JOB"), "schedule_id", "exec_date", F.col("event_ms").cast("string")).alias("sk"),
        "event", F.nullif("error", F.lit("")).alias("error"), F.nullif("duration", F.lit(0)).alias("duration"),
        F.nullif("run_id", F.lit("")).alias("run_id"), F.nullif("category", F.lit("")).alias("category"),
        (F.floor(F.col("event_ms") / 1000) + JOB_TTL_SECONDS).cast("bigint").alias("ttl_epoch"),
    )


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append parquet. A partitioned layout is rebalanced first: few files per folder, hot folders split."""
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("append").parquet(path)


def event_rows(events: DataFrame, *, now: Column, ttl_days: int = 90) -> DataFrame:
    """Event-log rows: key ``ms#type``, missing event time becomes ``now``, ttl from ``now`` (days <= 0 is 90)."""
    days = ttl_days if ttl_days > 0 else 90
    ms = F.coalesce("ts_ms", F.unix_millis(now))
    return events.withColumn("ts_ms", ms).select(
        F.concat(F.lit("PIPELINE#"), "pipeline_id").alias("pk"),
        F.concat(F.col("ts_ms").cast("string"), F.lit("#"), "event_type").alias("sk"),
        "event_type", "pipeline_id", "schedule_id", "exec_date", "message", "ts_ms",
        (F.unix_seconds(now) + days * 86_400).alias("ttl_epoch"),
        F.to_date(F.timestamp_millis("ts_ms")).alias("event_day"),
    )


def write_events(rows: DataFrame, path: str) -> None:
    """Append to the event log, laid out by day and type so type and time filters prune files."""
    append(rows, path, ["event_day", "event_type"])


def query_events(events: DataFrame, event_type: str, from_ms: Column, to_ms: Column) -> DataFrame:
    """Events of one type in a closed time range; the day filter prunes partitions."""
    day = F.col("event_day").between(F.to_date(F.timestamp_millis(from_ms)), F.to_date(F.timestamp_millis(to_ms)))
    return events.filter((F.col("event_type") == event_type) & day & F.col("ts_ms").between(from_ms, to_ms))


def unexpired(df: DataFrame, *, now: Column, ttl: str = "ttl_epoch") -> DataFrame:
    return df.filter(F.col(ttl).isNull() | (F.col(ttl) > F.unix_seconds(now)))


def dead_letters(rejects: DataFrame) -> DataFrame:
    """Dead-letter rows: full payload as JSON, pipeline id and error type."""
    payload = F.to_json(F.struct(*[c for c in rejects.columns if c not in ("error_type", "error")]))
    return rejects.select(
        F.xxhash64(payload).alias("dlq_id"), "pipeline_id", payload.alias("payload"), "error",
        F.coalesce("error_type", F.lit("UNKNOWN")).alias("error_type"))


# ---- control table view over typed tables ----------------------------------------------------------------

def control_table(configs: DataFrame, sensor_log: DataFrame, triggers: DataFrame, requests: DataFrame,
                  job_log: DataFrame) -> DataFrame:
    """The key/value form of the typed tables, as a change stream would deliver it.

    ``kind`` repeats the key prefix as a low-cardinality column: store the table partitioned by it and every
    prefix scan prunes to its own files.
    """
    def key(*parts: str | Column) -> Column:
        return F.concat_ws("#", *[F.lit(p) if isinstance(p, str) else p for p in parts])

    pk = F.concat(F.lit("PIPELINE#"), F.col("pipeline_id")).alias("pk")
    c = F.col
    rows = {
        "config": configs.select(pk, F.lit("CONFIG").alias("sk"), F.to_json("cfg").alias("config")),
        "sensor": sensor_log.select(pk, key("SENSOR", c("sensor_key")).alias("sk"), "seq", "ts",
                                    F.to_json("data").alias("data")),
        "trigger": triggers.select(pk, key("TRIGGER", c("schedule_id"), c("exec_date")).alias("sk"), "status",
                                   c("ttl_epoch").alias("ttl")),
        "rerun_request": requests.select(
            pk, key("RERUN_REQUEST", c("schedule_id"), c("exec_date")).alias("sk"), "seq", "reason",
            F.timestamp_millis("requested_ms").alias("ts")),
        "job": job_log.select(
            pk, key("JOB", c("schedule_id"), c("exec_date"), c("event_ms").cast("string")).alias("sk"),
            "seq", "event", "error", F.timestamp_millis("event_ms").alias("ts")),
    }
    tagged = [df.withColumn("kind", F.lit(k)) for k, df in rows.items()]
    out = tagged[0]
    for r in tagged[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
