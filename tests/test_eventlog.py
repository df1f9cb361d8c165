"""The live event log: one copy after replays, rejects beside the log, counts that add up."""

from pyspark.sql import functions as F

from slipway.operators.events import threads
from slipway.schema import RUN_KEY
from slipway.session import work_dir
from slipway.sources.control import event_rows
from slipway.streaming import eventlog as G, jobs as T

def now():
    return F.lit("2024-01-30 00:00:00").cast("timestamp")


def events(spark, n, start=0):
    rows = [("" if i % 7 == 3 else f"p{i % 4}", "s", "d", 1_706_000_000_000 + i * 3_600_000, None if i % 11 == 5 else
             ("JOB_FAILED", "JOB_COMPLETED", "JOB_TRIGGERED")[i % 3], f"m{i}") for i in range(start, start + n)]
    return spark.createDataFrame(rows, G.EVENT_DDL)


def messages(df):
    return sorted(r.message for r in df.collect())


def test_event_log_over_batches(spark):
    path = work_dir(spark, "events")
    for k in range(3):
        events(spark, 40, 40 * k).coalesce(1).write.mode("append").parquet(path)
    log = G.EventLog(spark, work_dir(spark, "log"))
    G.event_log_stream(T.read_stream(spark, path, events(spark, 1).schema, files_per_batch=1), log, now)
    every = events(spark, 120)
    good = every.filter("pipeline_id <> '' and event_type is not null")
    cols = ["pk", "sk", "event_type", "pipeline_id", "message", "ts_ms", "ttl_epoch", "event_day"]
    assert sorted(map(str, log.read(spark, "log").select(*cols).collect())) == sorted(
        map(str, event_rows(good, now=now()).select(*cols).collect()))
    assert messages(log.read(spark, "alerts")) == messages(good.filter("event_type <> 'JOB_TRIGGERED'"))
    bad = log.read(spark, "rejects")
    assert bad.count() + good.count() == 120 and {r.reason for r in bad.collect()} == {"missing pipeline", "missing type"}
    for c in log.commits(spark).collect():
        assert c.total == 40 == c.logged + c.rejected
    counted = log.commits(spark).agg(*[F.sum(c).alias(c) for c in ("total", "logged", "alerted", "rejected")]).first()
    assert tuple(counted) == (120, good.count(), log.read(spark, "alerts").count(), bad.count())


def test_a_replayed_batch_leaves_one_copy(spark):
    log = G.EventLog(spark, work_dir(spark, "log"))
    log.write(events(spark, 30), 0, now=now())
    first = messages(log.read(spark, "log")), messages(log.read(spark, "rejects"))
    log.write(events(spark, 30), 0, now=now())
    assert (messages(log.read(spark, "log")), messages(log.read(spark, "rejects"))) == first
    assert log.commits(spark).count() == 1


def test_an_uncommitted_batch_is_not_read(spark):
    log = G.EventLog(spark, work_dir(spark, "log"))
    log.write(events(spark, 30), 0, now=now())
    before = messages(log.read(spark, "log"))
    # The state a run leaves that was lost between its tables and its commit.
    event_rows(events(spark, 20, 100).filter("pipeline_id <> ''"), now=now()).write.partitionBy("event_day", "event_type").parquet(
        f"{log.path}/log/batch_id=1")
    assert messages(log.read(spark, "log")) == before
    log.write(events(spark, 20, 100), 1, now=now())
    assert len(messages(log.read(spark, "log"))) > len(before)


def test_empty_batches(spark):
    log = G.EventLog(spark, work_dir(spark, "log"))
    assert log.read(spark, "log").count() == 0
    log.write(events(spark, 0), 0, now=now())
    only_bad = spark.createDataFrame([(None, None, None, None, None, None)], G.EVENT_DDL)
    log.write(only_bad, 1, now=now())
    assert log.read(spark, "log").count() == 0 and log.read(spark, "alerts").count() == 0
    assert [r.reason for r in log.read(spark, "rejects").collect()] == ["missing pipeline"]


def test_threads_over_batches(spark):
    path = work_dir(spark, "alerts")
    every = events(spark, 90).withColumn("exec_date", F.concat(F.lit("d"), (F.col("ts_ms") % 5).cast("string")))
    every = every.filter("event_type is not null").withColumn("ts_ms", F.expr("ts_ms - ts_ms % 7200000"))  # ties
    cuts = [0, 1_706_000_000_000 + 30 * 3_600_000, 1_706_000_000_000 + 60 * 3_600_000, 1 << 50]
    for lo, hi in zip(cuts, cuts[1:]):
        every.filter(f"ts_ms >= {lo - lo % 7_200_000} and ts_ms < {hi - hi % 7_200_000}").coalesce(1).write.mode("append").parquet(path)
    out = T.StateTable(spark, work_dir(spark, "threaded"), G.THREADED_DDL)
    state = G.thread_state(spark, work_dir(spark, "threads"), buckets=3, deltas=2)
    G.thread_stream(T.read_stream(spark, path, every.schema, files_per_batch=1), state, out)
    batch = threads(every.withColumn("at", F.struct("ts_ms", "message")), order=["at"]).select(
        *RUN_KEY, "ts_ms", "message", F.col("thread_id.message").alias("thread_message"), "opens_thread")
    got = out.read(spark).select(*batch.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    runs = every.select(*RUN_KEY).distinct().count()
    assert state.read(spark).count() == runs == got.filter("opens_thread").count()
