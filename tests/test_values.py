"""Edge rows of value semantics, rules, dates, zones and deadlines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slipway.functions import values as V, zones as Z
from slipway.operators import calendars as C, clean as P, drift as D, rules as R, sla as L
from slipway.schema import CONFIG_STRUCT

UTC = dt.timezone.utc


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def at(text):
    return F.lit(text).cast("timestamp")


@pytest.mark.parametrize("value,text", [
    (1000.0, "1000"), (1e6, "1e+06"), (1234567.0, "1.234567e+06"), (123456.5, "123456.5"), (0.0001, "0.0001"),
    (0.00001, "1e-05"), (-2.5e-7, "-2.5e-07"), (1e21, "1e+21"), (123456789.0, "1.23456789e+08"), (0.0, "0"),
    (0.00025, "0.00025"), (float("inf"), "+Inf"), (1.5e300, "1.5e+300"),
])
def test_number_text(spark, value, text):
    assert one(spark, V.number_text(F.lit(value))) == text


@pytest.mark.parametrize("text,value", [
    ("5", 5.0), (" 5 ", None), ("5d", None), ("1e3", 1000.0), (".5", 0.5), ("", None), ("abc", None), ("1e400", None),
    ("-inf", float("-inf")), ("+7", 7.0),
])
def test_parse_number(spark, text, value):
    assert one(spark, V.parse_number(F.lit(text))) == value


@pytest.mark.parametrize("text,seconds", [
    ("1h30m", 5400.0), ("500ms", 0.5), ("0", 0.0), ("", None), ("-1.5h", -5400.0), ("2 h", None), ("90", None), ("1d", None),
])
def test_duration(spark, text, seconds):
    assert one(spark, V.duration_seconds(F.lit(text))) == seconds


@pytest.mark.parametrize("micros,text", [
    (0, "0s"), (1_500_000, "1.5s"), (20_000, "20ms"), (93_600_000_000, "26h0m0s"), (61_000_000, "1m1s"),
    (-5_400_000_000, "-1h30m0s"),
])
def test_duration_text(spark, micros, text):
    assert one(spark, V.duration_text(F.lit(micros).cast("bigint"))) == text


def test_rfc3339(spark):
    assert one(spark, V.rfc3339(F.lit("2024-01-02"))) is None
    assert one(spark, V.rfc3339(F.lit("2024-01-02T03:04:05"))) is None
    assert one(spark, F.unix_seconds(V.rfc3339(F.lit("2024-01-02T03:04:05+01:00")))) == 1704161045


RULES = [
    # check, field, rule value, sensor json, passed, code
    ("exists", "", None, '{"a":1}', True, None),
    ("exists", "", None, None, False, "missing_sensor"),
    ("equals", "s", '"ready"', '{"s":"ready"}', True, None),
    ("equals", "s", "true", '{"s":true}', True, None),
    ("equals", "s", '"true"', '{"s":true}', True, None),
    ("equals", "n", '"1000000"', '{"n":1000000}', False, "not_equal"),
    ("equals", "n", '"1000"', '{"n":1000}', True, None),
    ("equals", "n", "5", '{"n":5.0}', True, None),
    ("equals", "x", '"<nil>"', '{"x":null}', True, None),
    ("equals", "s", '"ready"', '{"t":1}', False, "missing_field"),
    ("equals", "s", '"ready"', None, False, "missing_sensor"),
    ("gte", "n", "5", '{"n":5}', True, None), ("lte", "n", "5", '{"n":5}', True, None),
    ("gt", "n", "5", '{"n":5}', False, "compare_false"), ("lt", "n", "5", '{"n":5}', False, "compare_false"),
    ("gt", "n", '"4.5"', '{"n":"5"}', True, None), ("gt", "n", "1", '{"n":true}', False, "field_not_numeric"),
    ("gt", "n", '"x"', '{"n":3}', False, "value_not_numeric"),
    ("age_lt", "t", '"2h"', '{"t":"2024-01-30T20:00:00Z"}', True, None),
    ("age_lt", "t", '"1h"', '{"t":"2024-01-30T20:00:00Z"}', False, "too_old"),
    ("age_lt", "t", '"1h"', '{"t":"2025-01-30T20:00:00Z"}', True, None),
    ("age_lt", "t", '"1h"', '{"t":17}', False, "not_timestamp_text"),
    ("age_lt", "t", '"1h"', '{"t":"yesterday"}', False, "bad_timestamp"),
    ("age_lt", "t", "3", '{"t":"2024-01-30T20:00:00Z"}', False, "value_not_duration"),
    ("age_lt", "t", '"soon"', '{"t":"2024-01-30T20:00:00Z"}', False, "bad_duration"),
    ("age_gt", "t", '"1h"', '{"t":"2024-01-30T20:00:00Z"}', False, "unknown_operator"),
]


def rule_rows(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)],
                               "i int, check string, field string, value string, j string, want boolean, code string")
    return df.select("i", "want", "code", F.struct(
        F.lit("k").alias("key"), "check", "field", F.parse_json("value").alias("value")).alias("rule"),
        F.from_json("j", "map<string,variant>").alias("data"))


def test_rule_verdicts(spark):
    for r in R.evaluate(rule_rows(spark), now=at("2024-01-30 21:30:00"), reasons=True).collect():
        assert (r.passed, r.reason_code) == (r.want, r.code), RULES[r.i]
        assert (r.reason is None) == r.passed


def test_reason_texts(spark):
    got = {r.i: r.reason for r in R.evaluate(rule_rows(spark), now=at("2024-01-30 21:30:00"), reasons=True).collect()}
    texts = {RULES[i][0] + ":" + str(RULES[i][5]): got[i] for i in got}
    assert texts["equals:not_equal"] == "expected 1000000, got 1e+06"
    assert texts["gt:compare_false"] == "5 gt 5 is false"
    assert texts["equals:missing_field"] == 'field "s" not found in sensor data'
    assert texts["age_lt:too_old"] == "age 1h30m0s exceeds threshold 1h0m0s"
    assert texts["age_gt:unknown_operator"] == 'unknown operator "age_gt"'


@pytest.mark.parametrize("mode,passes,want", [
    ("ALL", [True, False], False), ("ALL", [True, True], True), ("ANY", [True, False], True), ("any", [False], False),
    ("Any", [True], True), ("SOME", [True, False], False), ("ALL", [], True), ("ANY", [], False),
])
def test_combine(spark, mode, passes, want):
    rows = [("p", mode, i, ok) for i, ok in enumerate(passes)] or [("p", mode, None, None)]
    df = spark.createDataFrame(rows, "pipeline_id string, mode string, pos int, passed boolean")
    assert R.combine(df, ["pipeline_id"]).first().passed is want


@pytest.mark.parametrize("date,hour,want", [
    ("2026-03-03", "", "2026-03-03"), ("20260303", "07", "2026-03-03T07"), ("2026-03-03", "7", "2026-03-03"),
    ("2026-03-03", "25", "2026-03-03"), ("", "07", "2024-01-30"), ("2026-02-30", "07", "2024-01-30"),
    ("2026-03-03", "23", "2026-03-03T23"), ("nonsense", "", "2024-01-30"),
])
def test_execution_date(spark, date, hour, want):
    assert one(spark, Z.execution_date_of(F.lit(date), F.lit(hour), at("2024-01-30 21:30:00"))) == want


def cfg(spark, json):
    return spark.range(1).select(F.lit("p").alias("pipeline_id"), F.from_json(F.lit(json), CONFIG_STRUCT).alias("cfg"))


@pytest.mark.parametrize("date,want", [
    ("2026-03-07", True), ("2026-03-08", True), ("2026-03-06", False), ("2026-03-10", True), ("2026-03-10T05", True),
    ("2026", False), ("", False), ("notadate!!", False),
])
def test_excluded_dates(spark, date, want):
    c = cfg(spark, '{"schedule":{"exclude":{"weekends":true,"dates":["2026-03-10"]}}}')
    assert c.select(Z.excluded_date(F.col("cfg"), F.lit(date)).alias("x")).first().x is want


def test_excluded_time_uses_the_zone(spark):
    c = cfg(spark, '{"schedule":{"timezone":"Asia/Tokyo","exclude":{"weekends":true}}}')
    friday_evening = at("2026-03-06 16:00:00")  # Saturday in Tokyo
    assert c.select(Z.excluded_at(F.col("cfg"), friday_evening).alias("x")).first().x is True


@pytest.mark.parametrize("cron,want", [
    ("0 8 * * *", "2024-01-30 08:00:00"), ("45 22 * * *", "2024-01-29 22:45:00"), ("15 * * * *", "2024-01-30 21:15:00"),
    ("45 * * * *", "2024-01-30 20:45:00"), ("*/5 3 * * *", None), ("0 8 * *", None), ("0 1,2 * * *", None),
])
def test_last_cron_fire(spark, cron, want):
    got = one(spark, C.last_cron_fire(F.lit(cron), F.lit("UTC"), at("2024-01-30 21:30:00")).cast("string"))
    assert got == want


DEADLINES = [
    # date, deadline, expected, zone, now, breach, warning, error
    ("2026-03-28", "08:00", "30m", "UTC", "2026-03-28 05:00:00", "2026-03-28 08:00:00", "2026-03-28 07:30:00", None),
    ("2026-03-28", "08:00", "30m", "UTC", "2026-03-28 09:00:00", "2026-03-29 08:00:00", "2026-03-29 07:30:00", None),
    ("2026-03-28T10", ":30", "15m", "UTC", "2026-03-28 05:00:00", "2026-03-28 11:30:00", "2026-03-28 11:15:00", None),
    ("2026-03-28T23", ":30", "15m", "UTC", "2026-03-28 05:00:00", "2026-03-29 00:30:00", "2026-03-29 00:15:00", None),
    ("2026-03-28", "09:00", "1h", "America/New_York", "2026-03-28 05:00:00", "2026-03-28 13:00:00",
     "2026-03-28 12:00:00", None),
    ("2026-03-28", ":15", "5m", "", "2026-03-28 05:20:00", "2026-03-28 06:15:00", "2026-03-28 06:10:00", None),
    ("rubbish", "08:00", "30m", "UTC", "2026-03-28 05:00:00", "2026-03-28 08:00:00", "2026-03-28 07:30:00", None),
    ("2026-03-28", "8am", "30m", "UTC", "2026-03-28 05:00:00", None, None, "bad_deadline"),
    ("2026-03-28", "08:00", "", "UTC", "2026-03-28 05:00:00", None, None, "bad_duration"),
    ("2026-03-28", "08:00", "30m", "Not/AZone", "2026-03-28 05:00:00", None, None, "bad_timezone"),
]


def test_absolute_deadlines(spark):
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(DEADLINES)],
                               "i int, exec_date string, deadline string, expected_duration string, sla_timezone string,"
                               " now string")
    out = L.absolute_deadline(df, now=F.col("now").cast("timestamp"))
    for r in out.select("i", F.col("breach_at").cast("string").alias("b"), F.col("warning_at").cast("string").alias("w"),
                        "deadline_error").collect():
        assert (r.b, r.w, r.deadline_error) == DEADLINES[r.i][5:], DEADLINES[r.i]


def test_relative_deadline(spark):
    df = spark.createDataFrame([("4h", None), ("4h", "30m"), ("bad", None)], "max_duration string, expected_duration string")
    out = L.relative_deadline(df.withColumn("arrival_at", at("2024-01-01 00:00:00")))
    got = [tuple(r) for r in out.select(F.col("breach_at").cast("string"), F.col("warning_at").cast("string"),
                                        "deadline_error").collect()]
    assert got == [("2024-01-01 04:00:00", "2024-01-01 03:00:00", None),
                   ("2024-01-01 04:00:00", "2024-01-01 03:30:00", None), (None, None, "bad_max_duration")]


@pytest.mark.parametrize("local,zone,utc", [
    ("2023-10-29 01:15:00", "Europe/London", "2023-10-29 01:15:00"),   # second of the two
    ("2023-11-05 01:30:00", "America/New_York", "2023-11-05 05:30:00"),  # first of the two
    ("2024-07-01 12:00:00", "Asia/Tokyo", "2024-07-01 03:00:00"),
])
def test_fold_choice(spark, local, zone, utc):
    assert one(spark, Z.to_utc(at(local), F.lit(zone)).cast("string")) == utc


@pytest.mark.parametrize("name,ok", [("Europe/London", True), ("UTC", True), ("Not/AZone", False), ("", False),
                                     ("PST", False), ("America/Argentina/Buenos_Aires", True)])
def test_zone_names(spark, name, ok):
    assert one(spark, Z.is_zone(F.lit(name))) is ok


@pytest.mark.parametrize("prev,cur,threshold,want", [
    ('{"sensor_count":5000}', '{"sensor_count":0}', None, True), ('{"sensor_count":0}', '{"sensor_count":5000}', None, True),
    ('{"sensor_count":7}', '{"sensor_count":7}', None, False), ('{"sensor_count":7}', '{"sensor_count":"9"}', 2.0, False),
    ('{"sensor_count":7}', '{"sensor_count":"9.5"}', 2.0, True), ('{}', '{"sensor_count":1}', None, False),
    ('{"sensor_count":true}', '{"sensor_count":1}', None, False),
])
def test_drift(spark, prev, cur, threshold, want):
    df = spark.createDataFrame([(prev, cur, None, threshold)], "a string, b string, drift_field string, drift_threshold double")
    df = df.withColumns({"baseline": F.from_json("a", "map<string,variant>"), "data": F.from_json("b", "map<string,variant>")})
    assert D.drift_columns(df).first().drifted is want


def test_remap_prefers_the_dashed_period(spark):
    s = spark.createDataFrame([("p", "k#2026-03-03", '{"v":1}'), ("p", "k#20260303", '{"v":2}'), ("p", "k", '{"v":3}'),
                               ("p", "m", '{"v":4}')], "pipeline_id string, sensor_key string, j string")
    s = s.select("pipeline_id", "sensor_key", F.from_json("j", "map<string,variant>").alias("data"))
    wanted = spark.createDataFrame([("p", "2026-03-03", "k"), ("p", "2026-03-04", "k"), ("p", "2026-03-03", "m"),
                                    ("p", "2026-03-03", "z")], "pipeline_id string, exec_date string, key string")
    got = {(r.exec_date, r.key): r.sensor_key for r in P.remap_periods(wanted, s).collect()}
    assert got == {("2026-03-03", "k"): "k#2026-03-03", ("2026-03-04", "k"): "k", ("2026-03-03", "m"): "m",
                   ("2026-03-03", "z"): None}


def test_first_bytes_keep_whole_code_points(spark):
    texts = ["", "abc", "a" * 9, "\u00e9" * 9, "\u4e2d" * 5, "ab\u4e2d\u4e2d\u4e2d", "\U0001f600" * 3, "abc\U0001f600\U0001f600", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = [r.x for r in df.select("i", V.first_bytes(F.col("t"), 8).alias("x")).orderBy("i").collect()]

    def cut(t):
        return t and max((t[:k] for k in range(len(t) + 1) if len(t[:k].encode()) <= 8), key=len)

    assert got == [cut(t) for t in texts]


def test_sum_of_event_times_is_wider_than_a_bigint(spark):
    from types import SimpleNamespace

    from slipway.plans.base import p3

    ms = 9_000_000_000_000_000_000
    control = spark.createDataFrame([("job", "PIPELINE#p1", f"JOB#cron#2024-01-05#{ms}")] * 2, "kind string, pk string, sk string")
    row = p3(SimpleNamespace(control=control)).first()
    assert (row.n, row.ms, row.n_bad) == (2, 2 * ms, 0)
