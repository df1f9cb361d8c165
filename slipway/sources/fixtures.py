"""Control-plane views derived from the given tables (see FIXTURES.md section 2).

The given tables hold no sensors, configs or job logs, so each view is a deterministic projection or join of
them. Arithmetic is on integers; ``NOW`` pins the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slipway.functions import zones as Z
from slipway.schema import LOCK_SECONDS

NOW_TEXT = "2024-01-30 21:30:00"
JOB_TYPES = [
    "command", "http", "airflow", "glue", "emr", "emr-serverless", "step-function", "databricks", "lambda",
]


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(n: Column, cases: dict[int, str], default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for k, v in cases.items():
        out = F.when(n == k, F.lit(v)).otherwise(out)
    return out


def _rule(key: str, check: str, field: str, value: Column) -> Column:
    return F.struct(
        F.lit(key).alias("key"), F.lit(check).alias("check"), F.lit(field).alias("field"),
        value.cast("variant").alias("value"),
    )


def sensor_data(e: DataFrame) -> Column:
    u, i, ts = F.col("user_id"), F.col("event_id"), F.col("ts").cast("timestamp")
    ms = F.unix_millis(ts) - F.when(u % 4 == 0, 60 * 86_400_000).otherwise(0)
    updated = (
        F.when(i % 7 == 0, ms.cast("string").cast("variant"))
        .when(i % 5 == 0, F.floor(ms / 1000).cast("bigint").cast("variant"))
        .otherwise(ms.cast("variant"))
    )
    day = F.when(u % 3 == 0, F.date_format(ts, "yyyyMMdd")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    base = F.create_map(
        F.lit("count"), F.col("value").cast("variant"),
        F.lit("sensor_count"), F.col("value").cast("variant"),
        F.lit("k"), F.get_json_object("props", "$.k").cast("bigint").cast("variant"),
        F.lit("status"), F.when(i % 2 == 0, "ready").otherwise("pending").cast("variant"),
        F.lit("date"), day.cast("variant"),
        F.lit("updatedAt"), updated,
        F.lit("seenAt"), Z.V.rfc3339_text(ts).cast("variant"),
    )
    hour = F.create_map(F.lit("hour"), F.date_format(ts, "HH").cast("variant"))
    return F.when(u % 6 == 1, F.map_concat(base, hour)).otherwise(base)


def sensor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pipeline_id, sensor_key, ts, ts_ms, seq, data: one row per sensor write."""
    e = load(spark, sf_dir, "events")
    return from_events(e)


def from_events(e: DataFrame) -> DataFrame:
    u, ts = F.col("user_id"), F.col("ts").cast("timestamp")
    key = (
        F.when(u % 4 == 2, F.concat("event_type", F.lit("#"), F.date_format(ts, "yyyy-MM-dd")))
        .when(u % 4 == 3, F.concat("event_type", F.lit("#"), F.date_format(ts, "yyyyMMdd")))
        .otherwise(F.col("event_type"))
    )
    return e.select(
        F.concat(F.lit("p"), u.cast("string")).alias("pipeline_id"),
        key.alias("sensor_key"), ts.alias("ts"), F.unix_millis(ts).alias("ts_ms"), F.col("event_id").alias("seq"),
        sensor_data(e).alias("data"),
    )


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pipeline_id, cfg: one row per distinct user of ``events``."""
    u = F.col("user_id")
    users = load(spark, sf_dir, "events").select("user_id").distinct()
    rules = F.array_compact(F.array(
        _rule("purchase", "gte", "count", (F.lit(5) + u % 20)),
        _rule("error", "lt", "count", F.lit(50)),
        _rule("view", "equals", "status", F.lit("ready")),
        _rule("signup", "age_lt", "seenAt", F.lit("24h")),
        F.when(u % 10 == 0, _rule("refund", "exists", "", F.lit(None).cast("string"))),
        F.when(u % 12 == 5, _rule("view", "age_gt", "seenAt", F.lit("1h"))),
    ))
    post_rules = F.array_compact(F.array(
        _rule("purchase", "gt", "count", F.lit(0)),
        F.when(u % 3 == 1, _rule("pur", "exists", "", F.lit(None).cast("string"))),
    ))
    include = F.struct(F.array_compact(F.array(
        F.lit("2024-01-05"), F.lit("2024-01-12"), F.lit("2024-01-26"),
        F.when(u % 9 == 5, F.lit("2024-01-19")),
        F.when(u % 15 == 5, F.lit("2024-01-30")),
        F.lit("2024-02-09"),
        F.when(u % 27 == 5, F.lit("26/01/2024")),
    )).alias("dates"))
    exclude = F.when(
        u % 5 == 0,
        F.struct(F.lit(True).alias("weekends"), F.lit(None).cast("string").alias("holidays"),
                 F.array().cast("array<string>").alias("dates")),
    ).when(
        u % 7 == 3,
        F.struct(F.lit(False).alias("weekends"), F.lit("us").alias("holidays"),
                 F.array(F.lit("2024-01-15"), F.lit("2024-01-30")).alias("dates")),
    )
    schedule = F.struct(
        _pick(u % 8, {0: "30 6 * * *", 2: "15 * * * *", 4: "45 22 * * *", 6: "*/5 3 * * *"}).alias("cron"),
        _pick(u % 5, {1: "America/New_York", 2: "Europe/London", 3: "Asia/Tokyo", 4: "Not/AZone"}).alias("timezone"),
        F.when(u % 10 != 9, F.struct(
            F.lit("click").alias("key"), F.lit("gt").alias("check"), F.lit("count").alias("field"),
            F.lit(1).cast("variant").alias("value"),
            _pick(u % 6, {1: ":30", 3: "09:00", 5: "noon"}).alias("deadline"),
        )).alias("trigger"),
        exclude.alias("exclude"),
        F.when((u % 2 == 1) & (u % 3 == 2), include).alias("include"),
        _pick(u % 4, {1: "weekend", 3: "numbered"}).alias("calendar"),
        _pick(u % 6, {2: "22:00", 4: "05:00"}).alias("time"),
        F.struct(
            _pick(u % 3, {0: "1h", 1: "30m", 2: "90m"}).alias("window"),
            F.when(u % 11 == 0, "soon").otherwise(_pick(u % 3, {0: "5m", 1: "2m", 2: "10m"})).alias("interval"),
        ).alias("evaluation"),
    )
    sla = F.struct(
        F.when(u % 6 == 1, ":15").otherwise(
            F.concat(F.lpad((6 + u % 12).cast("string"), 2, "0"), F.lit(":00"))).alias("deadline"),
        F.when(u % 9 != 8, "30m").alias("expectedDuration"),
        F.when(u % 13 == 5, "25h").when(u % 4 == 1, "4h").alias("maxDuration"),
        F.when(u % 17 == 3, "Bad/Zone").otherwise(
            _pick(u % 5, {1: "America/New_York", 2: "Europe/London", 3: "Asia/Tokyo"})).alias("timezone"),
        F.lit(False).alias("critical"),
    )
    job = F.struct(
        F.element_at(F.array(*[F.lit(t) for t in JOB_TYPES]), (u % 9 + 1).cast("int")).alias("type"),
        F.lit(None).cast("map<string,variant>").alias("config"),
        (u % 12).cast("int").alias("maxRetries"),
        F.when(u % 16 == 10, 30).when(u % 4 == 1, 1800).when(u % 4 == 2, 7200).when(u % 4 == 3, 0)
        .cast("int").alias("jobPollWindowSeconds"),
        F.when(u % 29 == 6, 6).when(u % 5 != 4, u % 6).cast("int").alias("maxDriftReruns"),
        F.when(u % 6 != 5, u % 4).cast("int").alias("maxManualReruns"),
        F.when(u % 31 == 7, 9).when(u % 3 != 0, u % 4).cast("int").alias("maxCodeRetries"),
    )
    post_run = F.struct(
        post_rules.alias("rules"),
        _pick(u % 3, {1: "90m", 2: "bad"}).alias("sensorTimeout"),
        F.when(u % 10 != 0, (u % 10).cast("double")).alias("driftThreshold"),
        F.when(u % 2 == 0, "count").alias("driftField"),
    )
    cfg = F.struct(
        F.struct(F.concat(F.lit("p"), u.cast("string")).alias("id"),
                 F.concat(F.lit("team"), (u % 5).cast("string")).alias("owner"),
                 F.lit(None).cast("string").alias("description")).alias("pipeline"),
        schedule.alias("schedule"),
        F.when(u % 8 != 7, sla).alias("sla"),
        F.struct(_pick(u % 3, {0: "ANY", 1: "ALL", 2: "all"}).alias("trigger"),
                 F.when(u % 14 == 13, F.filter(rules, lambda r: F.lit(False))).otherwise(rules).alias("rules"),
                 ).alias("validation"),
        job.alias("job"),
        F.when(u % 9 != 4, post_run).alias("postRun"),
        (u % 7 == 0).alias("dryRun"),
    )
    return users.select(F.concat(F.lit("p"), u.cast("string")).alias("pipeline_id"), cfg.alias("cfg"))


def _orders_runs(orders: DataFrame) -> DataFrame:
    """Add run key columns and the start of the execution day to orders-shaped rows."""
    p = F.col("o_custkey") % 150
    day = F.date_add(F.lit("2023-10-03").cast("date"),
                     (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % 120))
    minute_ms = (F.col("o_orderkey") * 104729) % 86_400_000
    hour = F.floor(minute_ms / 3_600_000).cast("string")
    day_s = F.date_format(day, "yyyy-MM-dd")
    exec_date = F.when(p % 6 == 1, F.concat(day_s, F.lit("T"), F.lpad(hour, 2, "0"))).otherwise(day_s)
    return orders.withColumns({
        "pipeline_id": F.concat(F.lit("p"), p.cast("string")),
        "schedule_id": F.when(p % 2 == 0, "cron").otherwise("stream"),
        "exec_date": exec_date,
        "event_ms": F.unix_millis(day.cast("timestamp")) + minute_ms,
        "day_ms": F.unix_millis(day.cast("timestamp")),
    })


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    event = F.when(status == "F", "success").when(status == "O", "fail").otherwise("timeout")
    return _orders_runs(load(spark, sf_dir, "orders")).select(
        "pipeline_id", "schedule_id", "exec_date", "event_ms", F.col("o_orderkey").alias("seq"),
        event.alias("event"),
        F.when(status == "O", F.concat(F.lit("job failed with status "),
                                       F.when(urgent, "404").otherwise("503"))).alias("error"),
        F.floor(F.col("o_totalprice")).cast("bigint").alias("duration"),
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.when(event == "success", None).when(urgent, "PERMANENT").when(event == "timeout", "TIMEOUT")
        .otherwise("TRANSIENT").alias("category"),
    )


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run of the job log: status from the latest event, every 11th still RUNNING with a ttl."""
    from slipway.functions.ordered import latest_by

    latest = latest_by(job_log(spark, sf_dir), ["pipeline_id", "schedule_id", "exec_date"],
                       ["event_ms", "seq"], ["event"])
    running = F.col("seq") % 11 == 0
    return latest.select(
        "pipeline_id", "schedule_id", "exec_date",
        F.when(running, "RUNNING").when(F.col("event") == "success", "COMPLETED").otherwise("FAILED_FINAL")
        .alias("status"),
        F.when(running, F.floor(F.col("event_ms") / 1000) + LOCK_SECONDS).cast("bigint").alias("ttl_epoch"),
    )


def _line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    j = _orders_runs(li.join(o, li.l_orderkey == o.o_orderkey))
    offset = (F.col("l_orderkey") * 104729 + F.col("l_partkey") * 7919 + F.col("l_suppkey") * 31) % 86_400_000
    return j.withColumn("at_ms", F.col("day_ms") + offset).withColumn(
        "seq", (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000
        + F.col("l_partkey") % 1000 * 1000 + F.col("l_suppkey") % 1000)


def reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_runs(spark, sf_dir).filter(F.col("l_returnflag") != "R").select(
        "pipeline_id", "schedule_id", "exec_date",
        F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linenumber") % 2 == 0, "data-drift").otherwise("manual"))
        .otherwise("job-fail-retry").alias("reason"),
        F.col("at_ms").alias("triggered_ms"), "seq",
    )


def rerun_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_runs(spark, sf_dir).filter(F.col("l_returnflag") == "R").select(
        "pipeline_id", "schedule_id", "exec_date",
        _pick(F.col("l_linenumber") % 4, {0: "data-drift", 1: "late-data", 2: "manual", 3: ""}).alias("reason"),
        F.col("at_ms").alias("requested_ms"), "seq",
    )


def calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weekend calendar and one with a January 2024 date per nation."""
    n = load(spark, sf_dir, "nation")
    numbered = n.agg(F.sort_array(F.collect_set(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey")), "yyyy-MM-dd"))
    ).alias("dates"))
    weekend = load(spark, sf_dir, "region").agg(F.count("*")).select(
        F.lit("weekend").alias("name"), F.array(F.lit("saturday"), F.lit("sunday")).alias("days"),
        F.array().cast("array<string>").alias("dates"))
    return weekend.unionByName(numbered.select(
        F.lit("numbered").alias("name"), F.array().cast("array<string>").alias("days"), "dates"))


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider states of runs; text picked from the order's status and priority."""
    o = load(spark, sf_dir, "orders")
    t = F.element_at(F.array(*[F.lit(x) for x in JOB_TYPES]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    words = {
        "glue": ("SUCCEEDED", "FAILED", "RUNNING"), "emr": ("COMPLETED", "CANCELLED", "PENDING"),
        "emr-serverless": ("SUCCESS", "FAILED", "SUBMITTED"), "step-function": ("SUCCEEDED", "TIMED_OUT", "RUNNING"),
        "databricks": ("TERMINATED", "SKIPPED", "INTERNAL_ERROR"), "airflow": ("success", "failed", "queued"),
    }
    idx = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    state = F.lit("RUNNING")
    for k, v in words.items():
        state = F.when(t == k, F.element_at(F.array(*[F.lit(x) for x in v]), idx)).otherwise(state)
    return o.select(
        F.col("o_orderkey").alias("run_id"), t.alias("job_type"), state.alias("state"),
        F.when((t == "databricks") & (state == "TERMINATED"),
               F.when(F.col("o_orderpriority") == "5-LOW", "FAILED").otherwise("SUCCESS")).alias("result_state"),
    )


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines: every line of every document, in order, with severity words taken from the text itself."""
    d = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("run_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    n = F.length("line")
    message = (
        F.when(n % 97 == 5, F.concat(F.lit("24/01/30 ERROR Task - "), F.col("line")))
        .when(n % 89 == 7, F.concat(F.lit("24/01/30 FATAL Main - "), F.col("line")))
        .otherwise(F.col("line"))
    )
    analysis = F.concat(F.lit('{"Event":"GlueExceptionAnalysisJobFailed","Failure Reason":"'),
                        F.regexp_replace(F.substring("line", 1, 20), '"', ""), F.lit('"}'))
    rca = n % 211 == 11
    return d.select(
        "run_id", F.when(rca, "analysis").otherwise("driver").alias("stream"), F.col("line_no").alias("seq"),
        F.when(rca, analysis).otherwise(message).alias("message"),
    )
