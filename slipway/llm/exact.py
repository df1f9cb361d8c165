"""Exact duplicates by progressive refinement: length, then prefix hash, then the hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slipway.llm.common import Scratch, bitmap, in_bitmap, without_rows

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """Groups of documents with equal normalised text.

    Returns one row per distinct (id, text): ``id``, ``n`` (normalised length), ``p`` (prefix hash), ``keep_id``,
    ``group_size``, ``kept`` and ``text_hash``, which is null for documents that no other could equal.

    1. Only lengths that occur twice go on. 2. Of those, only (length, prefix hash) pairs that occur twice go on.
    3. Only for these documents is the whole text hashed (SHA-256); equal hashes form a group.
    The three steps move fixed-width rows, never text. Of a group, the smallest id stays.

    Null text is empty text, and all empty texts are equal. Null ids lose against any id; a group of null ids keeps a
    null id. Repeated rows (same id and text) count in ``group_size`` and give one row. An empty table gives no rows.
    Other columns of ``docs`` are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    sketch = scratch.table(base.select(
        "id", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("p")))
    lengths = scratch.table(sketch.groupBy("n").count().filter("count > 1").select("n"))
    same_length = sketch.join(lengths, "n", "left_semi")
    prefixes = scratch.table(same_length.groupBy("n", "p").count().filter("count > 1").select("n", "p"))
    left = scratch.table(sketch.join(prefixes, ["n", "p"], "left_semi").select("id").distinct())
    candidates = in_bitmap(bitmap(left, scratch), F.col("id"))
    full = base.filter(candidates).select(
        "id", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("p"),
        F.sha2("t", 256).alias("text_hash"))
    # An id of ``left`` may also stand on a row with another text; such a row becomes a group of its own below.
    full = scratch.table(full.alias("f").join(left.alias("l"), F.expr("f.id <=> l.id"), "left_semi"))
    groups = scratch.table(full.groupBy("text_hash").agg(
        F.min("id").alias("keep_id"), F.count("*").alias("group_size")))
    shared = full.distinct().join(groups, "text_hash").select(
        "id", "n", "p", "keep_id", "group_size", F.expr("id <=> keep_id").alias("kept"), "text_hash")
    alone = sketch.alias("s").join(left.alias("l"), F.expr("s.id <=> l.id"), "left_anti").select(
        "id", "n", "p", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.lit(None).cast("string").alias("text_hash"))
    return shared.unionByName(alone)


def with_digests(groups: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``exact_groups`` rows in report form, with the text hash of the documents that were alone too."""
    base = docs.select(F.col(id_col).alias("i"), normalised(F.col(text_col)).alias("t"))
    digests = base.select("i", F.length("t").alias("m"), F.xxhash64(F.substring("t", 1, 64)).alias("q"),
                          F.sha2("t", 256).alias("d"))
    report = [F.col("id").alias("doc_id"), "keep_id", "group_size", "kept"]
    alone = groups.filter("text_hash is null").join(digests, F.expr("id <=> i and n = m and p = q"))
    return groups.filter("text_hash is not null").select(*report, F.col("text_hash").alias("text_sha256")).unionByName(
        alone.select(*report, F.col("d").alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document per group of equal normalised texts, the one with the smallest id; all columns stay.

    Only the copies themselves go: another text that shares a copy's id stays. Null text is empty text. A row with a
    null id goes if a row with an id has its text; copies that all have null ids stay. Repeated rows (same id and text)
    stay or go together. An empty table gives no rows.
    """
    gone = exact_groups(docs, id_col, text_col).filter("not kept").select("id", "text_hash")
    return without_rows(docs, gone, id_col, F.sha2(normalised(F.col(text_col)), 256))
