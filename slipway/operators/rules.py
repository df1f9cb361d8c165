"""Declarative rules over sensor tables: per-rule verdicts, readiness per run, trigger conditions, config checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipway.functions import values as V, zones as Z
from slipway.functions.ordered import once
from slipway.operators.clean import remap_periods
from slipway.schema import JOB_BOUNDS, RUN_KEY

NUMERIC_CHECKS = ["gte", "lte", "gt", "lt"]


def evaluate(matched: DataFrame, *, now: Column, rule: Column | str = "rule", age_gt: bool = False,
             reasons: bool = False) -> DataFrame:
    """Add ``passed`` and ``reason_code`` (and message text in ``reason``) of each row's rule on its ``data``.

    Order of tests: exists, sensor present, field present, then the check itself. ``data`` is NULL when the
    sensor is missing; ``age_gt`` is unknown unless switched on. Values are decoded in steps, each one column, so
    that no decoding is repeated inside the verdict; messages are built for failed rows only.
    """
    r = F.col(rule) if isinstance(rule, str) else rule
    check, name = r["check"], F.coalesce(r["field"], F.lit(""))
    c = F.col
    steps = matched.withColumns({
        "_check": check, "_name": name, "_v": r["value"], "_a": V.field(c("data"), name),
        "_has": V.has_field(c("data"), name)})
    steps = steps.withColumns({"_ka": V.kind(c("_a")), "_kv": V.kind(c("_v"))})
    numeric = c("_check").isin(*NUMERIC_CHECKS)
    ages = c("_check").isin("age_lt", "age_gt") if age_gt else c("_check") == "age_lt"
    steps = steps.withColumns({
        "_na": F.when(numeric, V.number(c("_a"), c("_ka"))), "_nv": F.when(numeric, V.number(c("_v"), c("_kv"))),
        "_seen": F.when(ages & (c("_ka") == "STRING"), V.rfc3339(F.try_variant_get("_a", "$", "string"))),
        "_limit": F.when(ages & (c("_kv") == "STRING"), V.duration_micros(F.try_variant_get("_v", "$", "string"))),
    })
    a, t, k = c("_na"), c("_nv"), c("_check")
    compare = (k.isin("gt", "gte") & (a > t)) | (k.isin("lt", "lte") & (a < t)) | (k.isin("gte", "lte") & (a == t))
    compare = compare & ~F.isnan(a) & ~F.isnan(t)
    both_numbers = c("_ka").rlike(V.NUMERIC_KINDS) & c("_kv").rlike(V.NUMERIC_KINDS)
    equal = F.when(both_numbers, F.try_variant_get("_a", "$", "double") == F.try_variant_get("_v", "$", "double")) \
        .otherwise(V.printed(c("_a"), c("_ka")) == V.printed(c("_v"), c("_kv")))
    age = F.unix_micros(now) - F.unix_micros("_seen")
    age_ok = F.when(k == "age_gt", age > c("_limit")).otherwise(age < c("_limit"))
    code = (
        F.when(c("data").isNull(), "missing_sensor")
        .when(k == "exists", None)
        .when(~c("_has"), "missing_field")
        .when(k == "equals", F.when(~equal, "not_equal"))
        .when(numeric, F.when(a.isNull(), "field_not_numeric").when(t.isNull(), "value_not_numeric")
              .when(~compare, "compare_false"))
        .when(ages, F.when(c("_ka") != "STRING", "not_timestamp_text").when(c("_seen").isNull(), "bad_timestamp")
              .when(c("_kv") != "STRING", "value_not_duration").when(c("_limit").isNull(), "bad_duration")
              .when(~age_ok, "too_old"))
        .otherwise("unknown_operator")
    )
    out = once(steps, {"reason_code": code})
    out = out.withColumn("passed", c("reason_code").isNull())
    if reasons:
        out = out.withColumn("reason", _reason_text(age))
    return out.drop("_check", "_name", "_v", "_a", "_has", "_ka", "_kv", "_na", "_nv", "_seen", "_limit")


def _reason_text(age: Column) -> Column:
    c, lit = F.col, F.lit
    actual, wanted = V.printed(c("_a"), c("_ka")), V.printed(c("_v"), c("_kv"))
    field = F.concat(lit("field "), V.quoted(c("_name")))
    messages = {
        "missing_sensor": lit("sensor key does not exist"),
        "missing_field": F.concat(field, lit(" not found in sensor data")),
        "not_equal": F.concat(lit("expected "), wanted, lit(", got "), actual),
        "field_not_numeric": F.concat(field, lit(" value "), actual, lit(" is not numeric")),
        "value_not_numeric": F.concat(lit("rule value "), wanted, lit(" is not numeric")),
        "compare_false": F.concat(V.number_text(c("_na")), lit(" "), c("_check"), lit(" "),
                                  V.number_text(c("_nv")), lit(" is false")),
        "not_timestamp_text": F.concat(field, lit(" value is not a string timestamp")),
        "bad_timestamp": F.concat(field, lit(" value "), V.quoted(actual), lit(" is not a valid RFC3339 timestamp")),
        "value_not_duration": F.concat(lit("rule value "), wanted, lit(" is not a duration string")),
        "bad_duration": F.concat(lit("rule value "), V.quoted(wanted), lit(" is not a valid Go duration")),
        "too_old": F.concat(lit("age "), V.duration_text(age), lit(" exceeds threshold "),
                            V.duration_text(c("_limit"))),
        "unknown_operator": F.concat(lit("unknown operator "), V.quoted(c("_check"))),
    }
    out = lit(None).cast("string")
    for code, text in messages.items():
        out = F.when(c("reason_code") == code, text).otherwise(out)
    return out


def explode_rules(df: DataFrame, rules: Column, *, outer: bool = False) -> DataFrame:
    """One row per rule with its position; ``outer`` keeps rows of an empty rule list (NULL rule)."""
    gen = F.posexplode_outer(rules) if outer else F.posexplode(rules)
    keep = [c for c in df.columns if c not in ("cfg", "rules")]
    return df.select(*keep, gen.alias("pos", "rule"))


def match_sensors(rules: DataFrame, sensors: DataFrame) -> DataFrame:
    """Left equi-join of exploded rules with current sensors by exact key."""
    s = sensors.select("pipeline_id", F.col("sensor_key").alias("_key"), "data")
    return rules.withColumn("_key", F.col("rule.key")).join(s, ["pipeline_id", "_key"], "left").drop("_key")


def combine(results: DataFrame, keys: list[str], mode: str = "mode") -> DataFrame:
    """Verdict per group: ANY (any case) needs one pass, every other mode needs all; no rules: ALL passes."""
    counted = results.groupBy(*keys, mode).agg(
        F.count_if("passed").alias("n_passed"), F.count(F.col("pos")).alias("n_rules"))
    any_mode = F.upper(F.coalesce(mode, F.lit(""))) == "ANY"
    return counted.withColumn(
        "passed", F.when(any_mode, F.col("n_passed") > 0).otherwise(F.col("n_passed") == F.col("n_rules")))


def readiness(runs: DataFrame, configs: DataFrame, sensors: DataFrame, *, now: Column,
              reasons: bool = False) -> DataFrame:
    """Readiness of every run (RUN_KEY): passed, counts and ordered per-rule results; NULL config is an error row.

    Rules see per-period sensors of the run's execution date.
    """
    c = configs.select("pipeline_id", F.col("cfg.validation.trigger").alias("mode"),
                       F.col("cfg.validation.rules").alias("rules"))
    with_cfg = runs.select(*RUN_KEY).join(c.withColumn("_known", F.lit(True)), "pipeline_id", "left")
    rules = with_cfg.select(*RUN_KEY, "mode", "_known", F.posexplode_outer("rules").alias("pos", "rule"))
    wanted = rules.filter(F.col("pos").isNotNull()).select(
        "pipeline_id", "exec_date", F.col("rule.key").alias("key")).distinct()
    answers = remap_periods(wanted, sensors)
    matched = rules.withColumn("key", F.col("rule.key")).join(answers, ["pipeline_id", "exec_date", "key"], "left")
    results = evaluate(matched, now=now, reasons=reasons)
    any_mode = F.upper(F.coalesce("mode", F.lit(""))) == "ANY"
    grouped = results.groupBy(*RUN_KEY, "mode", "_known").agg(
        F.count_if(F.col("passed") & F.col("pos").isNotNull()).alias("n_passed"), F.count("pos").alias("n_rules"),
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct(
            "pos", F.col("rule.key").alias("key"), "passed", "reason_code", *(["reason"] if reasons else []))))).alias("results"),
    )
    passed = F.when(any_mode, F.col("n_passed") > 0).otherwise(F.col("n_passed") == F.col("n_rules"))
    return grouped.select(
        *RUN_KEY, "mode", "n_passed", "n_rules",
        F.when(F.col("_known").isNull(), "error").when(passed, "passed").otherwise("not_ready").alias("status"),
        F.when(F.col("_known").isNull(), F.lit("no config")).alias("error"), "results",
        F.when(F.col("_known") & passed, F.lit("VALIDATION_PASSED")).alias("event_type"),
    )


def trigger_hits(sensor_log: DataFrame, configs: DataFrame, *, now: Column | None = None) -> DataFrame:
    """Sensor rows whose key starts with their pipeline's trigger key and whose data meets the condition.

    The join is an equi-join on the pipeline with the prefix test as a residual; ``now`` defaults to the row's
    own write time.
    """
    at = F.col("ts") if now is None else now
    t = configs.filter(F.col("cfg.schedule.trigger").isNotNull())
    j = sensor_log.join(t, "pipeline_id").filter(
        F.col("sensor_key").startswith(F.coalesce(F.col("cfg.schedule.trigger.key"), F.lit(""))))
    return evaluate(j, rule=F.col("cfg")["schedule"]["trigger"], now=at).filter("passed").drop("passed", "reason_code")


def config_errors(configs: DataFrame) -> DataFrame:
    """Add ``errors``: every violated bound or combination of a config, in a fixed order."""
    c = F.col("cfg")
    job, schedule, sla = c["job"], c["schedule"], c["sla"]
    inc, trig = schedule["include"], schedule["trigger"]

    def bound(name: str, zero_ok: bool = False) -> Column:
        v, (lo, hi) = job[name], JOB_BOUNDS[name]
        bad = (v < lo) | (v > hi)
        bad = bad & (v != 0) if zero_ok else bad
        return F.when(bad, F.concat(F.lit(f"job.{name} "), v.cast("string"), F.lit(f" out of range [{lo},{hi}]")))

    dates = F.transform(
        F.coalesce(inc["dates"], F.array().cast("array<string>")),
        lambda d, i: F.when(V.valid_date(d).isNull(), F.concat(
            F.lit("schedule.include.dates["), i.cast("string"), F.lit("] invalid format "), V.quoted(d),
            F.lit(" (expected YYYY-MM-DD)"))),
    )
    relative = V.non_null_text(sla["maxDuration"])
    seconds = V.duration_seconds(sla["maxDuration"])
    dry = F.coalesce(c["dryRun"], F.lit(False))
    checks = F.concat(
        F.array(
            *[bound(name, zero_ok=name == "jobPollWindowSeconds") for name in JOB_BOUNDS],
            F.when(V.non_null_text(schedule["cron"]) & inc.isNotNull(),
                   F.lit("schedule.cron and schedule.include are mutually exclusive")),
            F.when(inc.isNotNull() & (F.coalesce(F.size(inc["dates"]), F.lit(0)) <= 0),
                   F.lit("schedule.include.dates must not be empty")),
        ),
        dates,
        F.array(
            F.when(relative & trig.isNull(),
                   F.lit("sla.maxDuration requires schedule.trigger (relative SLA needs a sensor signal)")),
            F.when(relative & seconds.isNull(),
                   F.concat(F.lit("sla.maxDuration invalid duration "), V.quoted(sla["maxDuration"]))),
            F.when(relative & (seconds > 86_400),
                   F.concat(F.lit("sla.maxDuration exceeds 24h ("), sla["maxDuration"], F.lit(")"))),
            F.when(dry & ~V.non_null_text(job["type"]), F.lit("dryRun requires job.type to be configured")),
            F.when(dry & trig.isNull(),
                   F.lit("dryRun requires schedule.trigger (sensor-driven evaluation)")),
        ),
    )
    return once(configs, {"errors": F.array_compact(checks)})


def valid_configs(configs: DataFrame) -> DataFrame:
    return config_errors(configs).filter(F.size("errors") == 0).drop("errors")


def excluded_hits(hits: DataFrame, *, now: Column | None = None) -> DataFrame:
    """Split marker for trigger hits: ``excluded`` by the wall clock, plus schedule id and execution date."""
    at = F.col("ts") if now is None else now
    return once(hits, {
        "excluded": Z.excluded_at(F.col("cfg"), at), "schedule_id": Z.schedule_id(F.col("cfg")),
        "exec_date": Z.execution_date(F.col("data"), at)})


def live_only(hits: DataFrame) -> DataFrame:
    """Hits that may start a run: neither excluded by the calendar nor of an observation-only pipeline."""
    return hits.filter(~F.col("excluded") & ~F.coalesce("cfg.dryRun", F.lit(False)))
