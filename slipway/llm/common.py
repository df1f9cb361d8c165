"""Staged tables, bounded bitmaps and whole-row filters shared by the corpus operators."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slipway.session import work_dir

BITMAP_BITS = 1 << 22  # 512 KB: the fixed size of every bitmap that is sent to all tasks


def small_batches(spark: SparkSession) -> None:
    """Rows here hold whole texts: fewer of them in an Arrow batch than Spark's 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


class Scratch:
    """Intermediate tables of one operator call, in the shared folder.

    Writing a table cuts its lineage, so a lost executor costs one stage. ``drop`` frees a table that nothing reads
    any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, work_dir(spark, name)
        small_batches(spark)
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._slipway_path = path
        return out

    def settle(self) -> None:
        """Let Spark delete the shuffle files of finished steps.

        It does so when the driver's garbage collector finds their plans unreachable; Python lets go of JVM objects
        about once a second.
        """
        gc.collect()
        time.sleep(2)
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._slipway_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _slot(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits))


def bitmap(values: DataFrame, scratch: Scratch, bits: int = BITMAP_BITS) -> Column:
    """A one-column table as a bitmap of fixed size, ready to be tested with ``in_bitmap``.

    The bitmap never grows with the table. A full one only lets more rows through to the exact join behind it.
    """
    spark, col = scratch.spark, values.columns[0]
    slots = values.select(_slot(F.col(col), bits).alias("s"))
    words = slots.groupBy(F.expr("shiftright(s, 6)").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
    dense = spark.range(0, bits // 64, 1, 4).withColumnRenamed("id", "w").join(words, "w", "left")
    one = dense.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))).alias("a"))
    return scratch.table(one.select(F.col("a.b").alias("bits"))).scalar()


def in_bitmap(bits: Column, value: Column, size: int = BITMAP_BITS) -> Column:
    return at_slot(bits, _slot(value, size))


def at_slot(bits: Column, s: Column) -> Column:
    word = F.get(bits, F.shiftright(s, 6).cast("int"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), s.bitwiseAND(F.lit(63)).cast("int"))
    return word.bitwiseAND(mask) != 0


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, row: Column, bits: int = BITMAP_BITS) -> DataFrame:
    """The rows of ``docs`` whose id and ``row`` are not in ``gone`` (id, row), with all their columns.

    ``row`` tells apart rows that share an id, such as a hash of the text; it is evaluated only where the id is in
    ``gone``. Rows whose id a bitmap clears pass straight from the scan; only the others are shuffled, with their text,
    for the exact anti join. Null ids are compared like values.
    """
    scratch = Scratch(docs.sparkSession, "without")
    gone = scratch.table(gone.toDF("__id", "__row").distinct())
    marked = in_bitmap(bitmap(gone.select("__id"), scratch, bits), F.col(id_col), bits)
    maybe = docs.filter(marked).withColumn("__row_here", row).join(
        gone, F.expr(f"`{id_col}` <=> __id and __row_here = __row"), "left_anti").drop("__row_here")
    return docs.filter(~marked).unionByName(maybe)
