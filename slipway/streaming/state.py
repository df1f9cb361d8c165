"""State of streaming jobs by key, kept in the shared folder: a micro-batch reads and writes only its own keys' buckets.

Rows are hashed into a fixed number of buckets. Each micro-batch writes its changes as one delta per touched bucket, and a
bucket that has collected ``deltas`` of them is written anew as a whole. A manifest per micro-batch names the parts that
make up every bucket; it is written last, so a micro-batch that fails or is replayed starts from the manifest before it.
So a lookup reads at most ``deltas`` parts of each bucket, however many micro-batches came before.

With ``slot``, a whole-number column is the bucket itself: a calendar of, say, the hours at which rows are due, of which
``through`` reads the buckets up to one hour and ``update`` can drop those that are done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from slipway.schema import RUN_KEY


class KeyedState:
    """The latest row per ``key``, among rows that are looked up by ``by`` (columns of the key; a run by default)."""

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: Sequence[str], *, by: Sequence[str] = RUN_KEY,
                 buckets: int = 16, deltas: int = 4, slot: str | None = None):
        self.path, self.key, self.by, self.buckets, self.deltas = path, list(key), list(by), buckets, deltas
        self.slot = slot
        self.columns = spark.createDataFrame([], ddl).columns
        self.ddl = f"{ddl}, _version BIGINT, _gone BOOLEAN"
        self._commit(spark, {}, -1)

    def seed(self, rows: DataFrame) -> KeyedState:
        """Start from a table of one row per key, before the first micro-batch."""
        self.update(rows, -1)
        return self

    def _bucket(self):
        if self.slot:
            return F.col(self.slot).cast("int").alias("bucket")
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int").alias("bucket")

    def _manifest(self, spark: SparkSession, batch_id: int) -> dict[int, list[str]]:
        """The parts of each bucket: one row per bucket, however large the state."""
        rows = spark.read.schema("bucket INT, parts ARRAY<STRING>").parquet(f"{self.path}/manifest/{batch_id}").collect()
        return {r.bucket: r.parts for r in rows}

    def _commit(self, spark: SparkSession, parts: dict[int, list[str]], batch_id: int) -> None:
        rows = spark.createDataFrame(sorted(parts.items()), "bucket INT, parts ARRAY<STRING>")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{batch_id}")

    def _rows(self, spark: SparkSession, parts: dict[int, list[str]]) -> DataFrame:
        folders = [f"{self.path}/data/{p}/bucket={b}" for b, names in parts.items() for p in names]
        rows = spark.read.schema(self.ddl).parquet(*folders) if folders else spark.createDataFrame([], self.ddl)
        last = F.max_by(F.struct(*[c for c in rows.columns if c not in self.key]), "_version").alias("r")
        return rows.groupBy(*self.key).agg(last).select(*self.key, "r.*").filter("not _gone")

    def lookup(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """Rows of the ``by`` values in ``keys``, as all micro-batches before this one left them."""
        spark = keys.sparkSession
        asked = keys.select(*self.by).distinct()
        touched = {r[0] for r in asked.select(self._bucket()).distinct().collect()}  # at most ``buckets`` numbers
        parts = {b: names for b, names in self._manifest(spark, batch_id - 1).items() if b in touched}
        return self._rows(spark, parts).select(*self.columns).join(asked, self.by, "left_semi")

    def through(self, spark: SparkSession, last: int, batch_id: int) -> DataFrame:
        """Rows of the slots up to ``last``, as all micro-batches before this one left them; no other slot is read."""
        parts = {b: names for b, names in self._manifest(spark, batch_id - 1).items() if b <= last}
        return self._rows(spark, parts).select(*self.columns)

    def update(self, rows: DataFrame, batch_id: int, gone: DataFrame | None = None, done_below: int | None = None) -> None:
        """Write new or changed rows (one per key), and take out the keys of ``gone`` and all slots below ``done_below``."""
        spark = rows.sparkSession
        changed = rows.select(*self.columns).withColumns({"_version": F.lit(batch_id).cast("bigint"), "_gone": F.lit(False)})
        if gone is not None:
            changed = changed.unionByName(gone.select(*self.key).withColumns(
                {"_version": F.lit(batch_id).cast("bigint"), "_gone": F.lit(True)}), allowMissingColumns=True)
        self._write(changed, str(batch_id))
        written = spark.read.schema(f"{self.ddl}, bucket INT").parquet(f"{self.path}/data/{batch_id}")
        touched = {r[0] for r in written.select("bucket").distinct().collect()}
        parts = self._manifest(spark, batch_id - 1) if batch_id >= 0 else {}
        full = {b: [*parts[b], str(batch_id)] for b in touched if len(parts.get(b, [])) >= self.deltas}
        parts |= {b: [*parts.get(b, []), str(batch_id)] for b in touched if b not in full}
        if full:
            self._write(self._rows(spark, full), f"{batch_id}-whole")
            kept = spark.read.schema(f"{self.ddl}, bucket INT").parquet(f"{self.path}/data/{batch_id}-whole")
            left = {r[0] for r in kept.select("bucket").distinct().collect()}
            parts |= {b: [f"{batch_id}-whole"] if b in left else [] for b in full}
        if done_below is not None:
            parts = {b: names for b, names in parts.items() if b >= done_below}
        self._commit(spark, parts, batch_id)

    def carry(self, spark: SparkSession, batch_id: int) -> None:
        """A micro-batch that changes nothing. Every micro-batch either carries or updates the state."""
        self._commit(spark, self._manifest(spark, batch_id - 1), batch_id)

    def _write(self, rows: DataFrame, part: str) -> None:
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{self.path}/data/{part}")

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows as of the last micro-batch."""
        done = spark.read.option("basePath", f"{self.path}/manifest").schema("bucket INT, parts ARRAY<STRING>").parquet(
            f"{self.path}/manifest/*").select(F.regexp_extract(F.input_file_name(), r"manifest/(-?\d+)/", 1).cast("int"))
        last = done.agg(F.max(done.columns[0])).first()[0]
        return self._rows(spark, self._manifest(spark, -1 if last is None else last)).select(*self.columns)
