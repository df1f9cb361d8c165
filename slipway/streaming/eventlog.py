"""Live event log and alert threads: each micro-batch goes to the log, the alerts and the rejects, and counts once for all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slipway.operators.events import ALERT_TYPES
from slipway.schema import RUN_KEY
from slipway.sources.control import event_rows
from slipway.session import staged
from slipway.streaming.jobs import RUN_DDL, StateTable, run_available
from slipway.streaming.state import KeyedState

COMMIT_DDL = "batch_id BIGINT, total BIGINT, logged BIGINT, alerted BIGINT, rejected BIGINT"
_LOG = (
    "pk STRING, sk STRING, event_type STRING, pipeline_id STRING, schedule_id STRING, exec_date STRING, message STRING,"
    " ts_ms BIGINT, ttl_epoch BIGINT, event_day DATE")
EVENT_DDL = f"{RUN_DDL}, ts_ms BIGINT, event_type STRING, message STRING"
TABLES = {"log": _LOG, "alerts": _LOG, "rejects": f"{EVENT_DDL}, reason STRING"}
LAYOUT = {"log": ["event_day", "event_type"], "alerts": [], "rejects": []}


def reject_reason(events: DataFrame) -> Column:
    """Why a record cannot be an event, else NULL."""
    def lacks(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    return F.when(lacks("pipeline_id"), "missing pipeline").when(lacks("event_type"), "missing type")


class EventLog:
    """Three tables of one folder per micro-batch and a commit row per micro-batch, written last.

    Readers see committed micro-batches only, so the tables agree with one another at any time; a replayed
    micro-batch overwrites its folders and its commit row. The log is laid out by day and type inside a micro-batch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        spark.createDataFrame([], COMMIT_DDL).write.mode("overwrite").parquet(f"{path}/commits/empty")
        for table, ddl in TABLES.items():
            spark.createDataFrame([], ddl).write.mode("overwrite").partitionBy(*LAYOUT[table]).parquet(f"{path}/{table}/batch_id=-1")

    def commits(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(COMMIT_DDL).parquet(f"{self.path}/commits/*")

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """Committed rows of ``log``, ``alerts`` or ``rejects``."""
        rows = spark.read.schema(f"{TABLES[table]}, batch_id BIGINT").parquet(f"{self.path}/{table}")
        return rows.join(self.commits(spark).select("batch_id"), "batch_id", "left_semi").drop("batch_id")

    def write(self, batch: DataFrame, batch_id: int, *, now: Column, ttl_days: int = 90) -> None:
        """Split one micro-batch. A bad record becomes a reject and never ends the micro-batch.

        The counts are those of the written files (their footers tell); records in must equal log rows plus rejects.
        """
        spark = batch.sparkSession
        split = staged(batch.withColumn("reason", reject_reason(batch)), "event-batch")
        log = event_rows(split.filter("reason is null"), now=now, ttl_days=ttl_days)
        parts = {"log": log, "alerts": log.filter(F.col("event_type").isin(*ALERT_TYPES)), "rejects": split.filter("reason is not null")}
        n = {"total": split.count()}
        for name, rows in parts.items():
            layout, folder = LAYOUT[name], f"{self.path}/{name}/batch_id={batch_id}"
            if layout:
                rows = rows.hint("rebalance", *layout)
            rows.write.mode("overwrite").partitionBy(*layout).parquet(folder)
            n[name] = spark.read.schema(TABLES[name]).parquet(folder).count()
        if n["total"] != n["log"] + n["rejects"]:
            raise RuntimeError(f"micro-batch {batch_id}: {n['total']} records, but {n['log']} logged and {n['rejects']} rejected")
        spark.createDataFrame([(batch_id, n["total"], n["log"], n["alerts"], n["rejects"])], COMMIT_DDL).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/commits/{batch_id}")


def event_log_stream(events: DataFrame, log: EventLog, now: Callable[[], Column], **options) -> None:
    """Append a stream of events (run key, event_type, message, ts_ms); ``now`` is asked once per micro-batch."""
    run_available(events, lambda batch, batch_id: log.write(batch, batch_id, now=now()), **options)


THREAD_DDL = f"{RUN_DDL}, thread_ms BIGINT, thread_message STRING"
THREADED_DDL = f"{EVENT_DDL}, thread_ms BIGINT, thread_message STRING, opens_thread BOOLEAN"


def thread_state(spark: SparkSession, path: str, **options) -> KeyedState:
    """The alert that opened each run's thread."""
    return KeyedState(spark, path, THREAD_DDL, RUN_KEY, **options)


def thread_stream(alerts: DataFrame, threads: KeyedState, out: StateTable, **options) -> None:
    """Each alert with its run's thread: the first writer opens it, and later micro-batches only look it up.

    Within a micro-batch the first alert by time and message opens the thread. An alert that comes late, in a later
    micro-batch, joins the thread that is there, as a message already sent cannot move.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        known = threads.lookup(batch, batch_id)
        first = batch.groupBy(*RUN_KEY).agg(F.min(F.struct("ts_ms", "message")).alias("_f"))
        new = first.join(known.select(*RUN_KEY), RUN_KEY, "left_anti").select(
            *RUN_KEY, F.col("_f.ts_ms").alias("thread_ms"), F.col("_f.message").alias("thread_message"))
        opens = (F.col("ts_ms") == F.col("thread_ms")) & F.col("message").eqNullSafe(F.col("thread_message"))
        out.write(batch.join(known.unionByName(new), RUN_KEY).select(
            *RUN_KEY, "ts_ms", "event_type", "message", "thread_ms", "thread_message", opens.alias("opens_thread")), batch_id)
        threads.update(new, batch_id)

    run_available(alerts, each, **options)
