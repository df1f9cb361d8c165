"""Table-level cleansing: unwrapping, typing, key splitting, execution dates, per-period keys, run plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipway.functions import values as V, zones as Z
from slipway.schema import LOCK_SECONDS, RUN_TIMEOUT_SECONDS

RUN_ID_KEYS = ["runId", "jobRunId", "glue_job_run_id", "executionArn", "stepId", "dagRunId"]  # fixed, in order


def type_attributes(df: DataFrame, json_col: str, out: str = "data") -> DataFrame:
    """JSON object text to MAP<STRING, VARIANT>; numbers, strings, booleans and nested values keep their kind."""
    return df.withColumn(out, F.from_json(json_col, "map<string,variant>"))


def unwrap_image(df: DataFrame, image: str = "image", *, mode: str = "stream") -> DataFrame:
    """Replace a row image (MAP<STRING, VARIANT>) by sensor fields in ``data``.

    ``stream`` mode takes the nested ``data`` object, or all attributes but the keys and ttl when there is none;
    ``pull`` mode takes the nested object only.
    """
    img = F.col(image)
    nested_text = F.to_json(V.field(img, F.lit("data")))
    nested = F.when(V.kind(V.field(img, F.lit("data"))).startswith("OBJECT"),
                    F.from_json(nested_text, "map<string,variant>"))
    flat = F.map_filter(img, lambda k, _: ~k.isin("PK", "SK", "ttl"))
    return df.withColumn("data", F.coalesce(nested, flat) if mode == "stream" else nested)


def split_keys(df: DataFrame) -> DataFrame:
    """Split ``pk``/``sk`` into pipeline and key parts; rows of a bad form carry ``key_error``."""
    sk = F.col("sk")
    prefix = F.split_part(sk, F.lit("#"), F.lit(1))
    rest = F.when(F.locate("#", sk) > 0, sk.substr(F.locate("#", sk) + 1, F.length(sk)))
    pair, triple = F.split(rest, "#", 2), F.split(rest, "#", 3)
    pk_ok = F.col("pk").startswith("PIPELINE#")
    two = prefix.isin("TRIGGER", "RERUN_REQUEST")
    job = prefix == "JOB"
    size_ok = F.when(two, F.size(pair) == 2).when(job, F.size(triple) == 3).otherwise(F.lit(True))
    good = F.coalesce(pk_ok & size_ok, F.lit(False))
    return df.withColumns({
        "pipeline_id": F.when(good, F.regexp_replace("pk", "^PIPELINE#", "")),
        "schedule_id": F.when(good & (two | job), F.get(triple, F.lit(0))),
        "exec_date": F.when(good & two, F.get(pair, F.lit(1))).when(good & job, F.get(triple, F.lit(1))),
        "event_ms": F.when(good & job, F.get(triple, F.lit(2)).try_cast("bigint")),
        "key_error": F.when(~F.coalesce(pk_ok, F.lit(False)), F.lit("unexpected pk"))
        .when(~F.coalesce(size_ok, F.lit(False)), F.lit("invalid sk")),
    })


def execution_dates(sensors: DataFrame, *, now: Column) -> DataFrame:
    """Add ``exec_date`` and its ``date_part`` and ``hour_part``."""
    out = sensors.withColumn("exec_date", Z.execution_date(F.col("data"), now))
    return out.withColumns({
        "date_part": Z.date_part(F.col("exec_date")), "hour_part": Z.hour_part(F.col("exec_date"))})


def period_key(sensor_key: Column) -> tuple[Column, Column]:
    """(base key, dashed period) of ``base#2024-01-05``, ``base#20240105T07`` ...; period NULL for a plain key."""
    tail = F.substring_index(sensor_key, "#", -1)
    dashed = F.regexp_replace(tail, r"^(\d{4})(\d{2})(\d{2})(T.*)?$", "$1-$2-$3$4")
    has = sensor_key.contains("#")
    base = F.when(has, sensor_key.substr(F.lit(1), F.length(sensor_key) - F.length(tail) - 1)).otherwise(sensor_key)
    return base, F.when(has, dashed)


def remap_periods(wanted: DataFrame, sensors: DataFrame, *, key: str = "key") -> DataFrame:
    """Resolve (pipeline_id, exec_date, key) to the sensor answering it.

    A key suffixed with the execution date (dashed first, then without dashes) overrides the plain key. Each
    wanted row offers its three spellings to one equi-join; the best hit wins in a partial aggregate.
    ``wanted`` rows must be unique. Adds ``sensor_key`` and ``data`` (NULL when nothing answers).
    """
    compact = F.replace("exec_date", F.lit("-"), F.lit(""))
    spellings = F.array(
        F.concat(key, F.lit("#"), "exec_date"), F.concat(key, F.lit("#"), compact), F.col(key))
    asked = wanted.select(*wanted.columns, F.posexplode(spellings).alias("_p", "_key"))
    s = sensors.select("pipeline_id", F.col("sensor_key").alias("_key"), "data")
    hit = asked.join(s, ["pipeline_id", "_key"], "left")
    found = F.when(F.col("data").isNotNull(), F.col("_p"))
    best = hit.groupBy(*wanted.columns).agg(F.min_by(F.struct("_key", "data"), found).alias("_b"))
    return best.select(*wanted.columns, F.col("_b._key").alias("sensor_key"), F.col("_b.data").alias("data"))


def run_plan(configs: DataFrame, *, run_timeout_seconds: int = RUN_TIMEOUT_SECONDS) -> DataFrame:
    """One row per config: schedule id, zone, evaluation and poll timing, lock life, window check."""
    c = F.col("cfg")
    ev = c["schedule"]["evaluation"]

    def seconds(s: Column, default: int) -> Column:
        d = V.duration_seconds(s)
        # Clocks count whole seconds; what is under one second has no usable value.
        return F.when(d >= 1, F.floor(d)).otherwise(default).cast("bigint")

    window, interval = seconds(ev["window"], 3600), seconds(ev["interval"], 300)
    poll = F.when(c["job"]["jobPollWindowSeconds"] > 0, c["job"]["jobPollWindowSeconds"]).otherwise(3600)
    lock = run_timeout_seconds + 1800 if run_timeout_seconds > 0 else LOCK_SECONDS
    return configs.select(
        "pipeline_id", Z.schedule_id(c).alias("schedule_id"), Z.zone_or_utc(c["schedule"]["timezone"]).alias("zone"),
        interval.alias("eval_interval_s"), window.alias("eval_window_s"), F.lit(60).cast("bigint").alias("poll_interval_s"),
        poll.cast("bigint").alias("poll_window_s"), F.lit(lock).cast("bigint").alias("lock_s"),
        ((window + poll) > lock - 1800).alias("windows_exceed_timeout"),
    )


def run_parameters(runs: DataFrame, *, job_type: str = "job_type", body: str = "body", metadata: str = "metadata"
                   ) -> DataFrame:
    """Add run arguments (``par_day``, ``par_hour``) and the run id from start metadata."""
    day = F.replace(Z.date_part(F.col("exec_date")), F.lit("-"), F.lit(""))
    hour = Z.hour_part(F.col("exec_date"))

    def args(prefix: str) -> Column:
        base = F.create_map(F.lit(f"{prefix}par_day"), day)
        return F.when(hour != "", F.map_concat(base, F.create_map(F.lit(f"{prefix}par_hour"), hour))).otherwise(base)

    http_body = F.when(V.non_null_text(F.col(body)), F.col(body)).otherwise(F.to_json(args("")))
    meta = F.col(metadata)
    run_id = F.coalesce(*[F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in RUN_ID_KEYS], F.lit(""))
    return runs.withColumns({
        "arguments": F.when(F.col(job_type) == "glue", args("--")),
        "body": F.when(F.col(job_type) == "http", http_body).otherwise(F.col(body)),
        "run_id": run_id,
    })
