"""Order-dependent operators that stay parallel inside a hot key.

A window partitioned by the key alone puts a whole key into one task. Every helper here splits a key by a time
bucket first, does the ordered work inside (key, bucket), and carries a one-row-per-bucket summary across
buckets, so the largest sorted group is one bucket of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HOUR_MS = 3_600_000
DAY_MS = 86_400_000
MINUTE_MS = 60_000


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Latest row per key as a partially combinable aggregate (no sort of the whole group)."""
    top = F.max(F.struct(*order)).alias("_o") if not payload else F.max_by(
        F.struct(*order, *payload), F.struct(*order)
    ).alias("_o")
    return df.groupBy(*keys).agg(top).select(*keys, "_o.*")


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    top = F.min(F.struct(*order)).alias("_o") if not payload else F.min_by(
        F.struct(*order, *payload), F.struct(*order)
    ).alias("_o")
    return df.groupBy(*keys).agg(top).select(*keys, "_o.*")


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    ms: str,
    order: Sequence[str],
    sums: dict[str, Column],
    *,
    bucket_ms: int = HOUR_MS,
) -> DataFrame:
    """Add, per key, the sum of each expression over all rows strictly before the current one.

    ``ms`` is the epoch-millisecond order column; ``order`` are the tie-breaks after it.
    """
    b = df.withColumn("_b", F.floor(F.col(ms) / bucket_ms)).withColumns(
        {f"_v_{n}": F.coalesce(e.cast("bigint"), F.lit(0)) for n, e in sums.items()}
    )
    by_bucket = W.partitionBy(*keys, "_b").orderBy(ms, *order).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        b.groupBy(*keys, "_b")
        .agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
        .select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{n}").over(across), F.lit(0)).alias(f"_p_{n}") for n in sums])
    )
    local = b.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(by_bucket), F.lit(0)) for n in sums})
    joined = local.join(totals, [*keys, "_b"], "inner")
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_p_{n}")).alias(n) for n in sums])


def as_of(
    probes: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    *,
    probe_ms: str,
    fact_ms: str,
    fact_order: Sequence[str],
    payload: Sequence[str],
    out: str,
    bucket_ms: int = HOUR_MS,
) -> DataFrame:
    """Attach to each probe the payload struct of the latest fact with ``fact_ms <= probe_ms`` (NULL if none).

    Keys must not be NULL. Linear: probes and facts are unioned once and sorted inside (key, bucket); only
    bucket summaries travel across buckets.
    """
    fact_key = F.struct(F.col(fact_ms).alias("ms"), *fact_order)
    f = facts.select(
        *keys,
        F.floor(F.col(fact_ms) / bucket_ms).alias("_b"),
        F.col(fact_ms).alias("_ms"),
        fact_key.alias("_ord"),
        F.struct(*payload).alias("_fact"),
    )
    p = probes.select(
        *keys,
        F.floor(F.col(probe_ms) / bucket_ms).alias("_b"),
        F.col(probe_ms).alias("_ms"),
        F.struct(*[c for c in probes.columns if c not in keys]).alias("_probe"),
    )
    rows = f.unionByName(p, allowMissingColumns=True)
    w = (
        W.partitionBy(*keys, "_b")
        .orderBy("_ms", F.col("_probe").isNotNull(), "_ord")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    local = rows.withColumn("_here", F.last("_fact", ignorenulls=True).over(w)).filter(F.col("_probe").isNotNull())

    ends = f.groupBy(*keys, "_b").agg(F.max_by("_fact", "_ord").alias("_end"))
    asked = p.select(*keys, "_b").distinct()
    earlier = W.partitionBy(*keys).orderBy("_b", F.col("_ask").desc()).rowsBetween(W.unboundedPreceding, 0)
    carried = (
        ends.withColumn("_ask", F.lit(False))
        .unionByName(asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True)
        .withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier))
        .filter("_ask")
        .select(*keys, "_b", "_carry")
    )
    return local.join(carried, [*keys, "_b"], "left").select(
        *keys, "_probe.*", F.coalesce("_here", "_carry").alias(out)
    )


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose expressions are evaluated exactly once per row.

    Filters on ordinary projections are pushed below them by copying the expression, which multiplies long
    expressions; a one-element ``inline`` keeps the computed values as plain columns. Filters on other columns still
    pass through to the scan.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))
