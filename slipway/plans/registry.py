"""Query registry: name -> (Spark callable, SQL statement or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from slipway.plans import views
from slipway.session import prepare, work_dir
from slipway.sources import control as S, fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


STORED = ("sensor_log", "sensors", "configs", "job_log", "triggers", "reruns", "rerun_requests")
ROWS_PER_FILE = 20_000
_paths: dict[tuple[str, str, str], tuple[str, StructType]] = {}


class Tables:
    """The control-plane tables of one data directory.

    Derived tables are written once per session into the shared folder and read back, as a deployment would keep
    them; queries then scan stored tables with column pruning and filter pushdown.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.now = X.now()

    def _derive(self, name: str) -> DataFrame:
        if name == "sensors":
            return S.latest_sensors(self.sensor_log)
        return getattr(X, name)(self.spark, self.sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in STORED:
            return getattr(X, name)(self.spark, self.sf_dir)
        return self.stored(name, lambda: self._derive(name))

    def stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table the engine itself keeps (run starts, baselines, markers): written on first use, then read."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _paths:
            path = work_dir(self.spark, name)
            df = make()
            # Files of bounded rows, so that later scans keep every core busy, whatever the input's files were.
            df.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
            _paths[key] = (path, df.schema)
        path, schema = _paths[key]
        return self.spark.read.schema(schema).parquet(path)

    def path(self, name: str) -> str:
        """Folder of a table that has been stored."""
        return _paths[self.spark.sparkContext.applicationId, self.sf_dir, name][0]

    def store_all(self) -> None:
        for name in STORED:
            getattr(self, name)

    @property
    def control(self) -> DataFrame:
        return S.control_table(self.configs, self.sensor_log, self.triggers, self.rerun_requests, self.job_log)

    def table(self, name: str) -> DataFrame:
        return X.load(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(prepare(spark), sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = views.expand(sql, extra)
        return fn

    return register


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def secs(ts: Column) -> Column:
    return F.unix_seconds(ts)
