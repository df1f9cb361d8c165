"""Mixing sources to target weights by hierarchical budgets. DataFrame functions only.

The token budget flows down a domain - language - source tree. At each node the children share the node's budget by
weight; a child that cannot use its share (its texts run out after the allowed epochs) leaves the rest to its
siblings. A node is never given more than its subtree can use, so a shortage reaches an ancestor's siblings only when
the whole subtree is used up. Each leaf then takes whole epochs, and of one more seeded epoch the prefix that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from slipway.llm.common import Scratch

LEVELS = ("domain", "lang", "source")
TOKEN = r"[^\x20\x09-\x0D]+"
HEX_BUCKET = 3  # hex digits of the order key that name a bucket: 4096 buckets of each leaf are summed apart


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def _weight(path: list[str], weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, _: k == F.concat_ws("/", *path))), F.lit(0)),
                      F.lit(1)).cast("long")


def _share(nodes: DataFrame, level: int) -> DataFrame:
    """Divide each parent's ``budget`` among its children: exact integer water filling.

    Children are taken in the order of capacity per weight; one is full if its capacity is no more than its share of
    what is left. The others split the rest by weight, in whole tokens that add up exactly.
    """
    parent, key = list(LEVELS[:level]), LEVELS[level]
    by = W.partitionBy(*parent, "budget").orderBy(F.expr("try_divide(cap, w)").asc_nulls_last(), key)
    nodes = nodes.withColumn("used", F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    nodes = nodes.withColumn("w_left", F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)))
    nodes = nodes.withColumn("full", _wide("cap") * _wide("w_left") <= _wide("w") * (_wide("budget") - _wide("used")))
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    free = F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))
    nodes = nodes.withColumn("free", free).withColumn("rest", F.greatest(
        F.lit(0), F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))))
    nodes = nodes.withColumn("all_free", F.sum("free").over(whole)).withColumn(
        "cum", F.sum("free").over(by.rowsBetween(W.unboundedPreceding, 0)))
    part = F.expr("""CASE WHEN full THEN cap WHEN all_free = 0 THEN 0L ELSE
        (cast(rest as decimal(19,0)) * cast(cum as decimal(19,0))) div cast(all_free as decimal(19,0))
        - (cast(rest as decimal(19,0)) * cast(cum - free as decimal(19,0))) div cast(all_free as decimal(19,0)) END""")
    return nodes.withColumn("budget", part)


def leaf_budgets(leaves: DataFrame, weights: dict[str, int], budget_pct: int, max_epochs: int) -> DataFrame:
    """Tokens for every leaf: domain, lang, source, available, budget. ``leaves`` has LEVELS and ``available``."""
    cap = F.when(_weight(list(LEVELS), weights) > 0, F.col("available") * max_epochs).otherwise(F.lit(0))
    caps = leaves.select(*LEVELS, "available", _weight(list(LEVELS), weights).alias("w"), cap.cast("long").alias("cap"))
    tables = {2: caps}
    for level in (1, 0):
        path = list(LEVELS[:level + 1])
        w = _weight(path, weights)
        up = tables[level + 1].groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", w)
        tables[level] = up.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0)).cast("long"))
    total = leaves.agg(F.expr(f"cast(sum(available) * {int(budget_pct)} div 100 as long)").alias("budget"))
    shared = _share(tables[0].withColumn("budget", total.scalar()), 0)
    for level in (1, 2):
        path = list(LEVELS[:level])
        shared = _share(tables[level].join(shared.select(*path, "budget"), path), level)
    return shared.select(*LEVELS, "available", "budget")


def mix(docs: DataFrame, domain: Column, weights: dict[str, int], budget_pct: int = 50, max_epochs: int = 2,
        seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Selected documents: doc_id, domain, lang, source, n_tokens, copies (epochs that include it, at least 1).

    ``weights`` maps tree paths (``domain``, ``domain/lang``, ``domain/lang/source``) to whole weights among siblings,
    1 where none is given; 0 leaves a subtree out. ``budget_pct`` of all tokens are wanted, no document more than
    ``max_epochs`` times. Epoch e of a leaf orders its documents by a hash of (seed, e, id); the last, partial epoch
    takes the longest prefix of that order whose tokens fit.

    Null lang, source or domain count as the empty name. Null and empty texts have no tokens and are never selected.
    Repeated rows are documents of their own; ties of the order key are broken by length. An empty table selects
    nothing. Other columns are not read, but for those that ``domain`` names.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = scratch.table(docs.select(
        F.col(id_col).alias("doc_id"), key.alias("k"), F.coalesce(domain, F.lit("")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens")).filter("n_tokens > 0"))
    leaves = scratch.table(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available")))
    plan = scratch.table(leaf_budgets(leaves, weights, budget_pct, max_epochs).select(
        *LEVELS, F.expr("budget div available").alias("whole"), F.expr("budget % available").alias("part")))
    ordered = rows.join(plan, list(LEVELS)).withColumn(
        "o", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("whole").cast("string"), "k"))).withColumn(
        "bucket", F.substring("o", 1, HEX_BUCKET))
    leaf_bucket = [*LEVELS, "bucket"]
    sums = ordered.groupBy(*leaf_bucket).agg(F.sum("n_tokens").alias("t"))
    earlier = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = scratch.table(sums.select(*leaf_bucket, F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("before")))
    inside = W.partitionBy(*leaf_bucket).orderBy("o", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    taken = ordered.join(sums, leaf_bucket).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
    copies = F.col("whole") + F.when(F.col("upto") <= F.col("part"), F.lit(1)).otherwise(F.lit(0))
    return taken.withColumn("copies", copies).filter("copies > 0").select(
        "doc_id", *LEVELS, "n_tokens", "copies")
