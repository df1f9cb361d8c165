"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster should set too; partition counts are left to adaptive execution.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
}
# Wide projections generate methods above the JIT size limit; let the JVM compile them (executors need it too).
HUGE_METHODS = "-XX:-DontCompileHugeMethods"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the results depend on (UTC clock) and the adaptive ones."""
    for k, v in DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Write an intermediate result once and read it back: cuts the lineage and survives lost executors.

    ``by`` names columns whose values get folders of their own, which filters on them prune.
    """
    path = work_dir(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: str = "8", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("slipway")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.extraJavaOptions", HUGE_METHODS)
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    )
    return prepare(builder.getOrCreate())
