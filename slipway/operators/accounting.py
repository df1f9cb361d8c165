"""Batch accounting: every record ends processed, dead-lettered or retried, and the sums must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from slipway.functions.ordered import earliest_by
from slipway.session import staged

TRANSIENT_KINDS = ["timeout", "deadline_exceeded", "dns_temporary"]  # fixed values
MAX_ATTEMPTS = 3


def error_class(kind: Column) -> Column:
    return F.when(kind.isin(*TRANSIENT_KINDS), "transient").otherwise("permanent")


def split_outcomes(records: DataFrame, *, error_kind: str = "error_kind", routed: str = "dlq_ok") -> DataFrame:
    """Add ``outcome``: processed, dead_letter, or retry (transient, or the dead-letter write failed)."""
    k = F.col(error_kind)
    permanent = error_class(k) == "permanent"
    return records.withColumn("outcome", F.when(k.isNull(), "processed").when(permanent & F.col(routed), "dead_letter")
                              .otherwise("retry"))


def batch_stats(split: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Counts per batch and whether they add up to its total."""
    s = split.groupBy(batch).agg(
        F.count_if(F.col("outcome") == "processed").alias("processed"),
        F.count_if(F.col("outcome") == "dead_letter").alias("dead_lettered"),
        F.count_if(F.col("outcome") == "retry").alias("retried"), F.count("*").alias("total"))
    return s.withColumn("balanced", F.col("processed") + F.col("dead_lettered") + F.col("retried") == F.col("total"))


def reconcile(sent: DataFrame, outcomes: DataFrame, *, order: list[str]) -> DataFrame:
    """State per record id: PENDING (possible loss), ACKED or REJECTED by its first valid outcome.

    Outcomes for unknown ids give state UNKNOWN; ``n_invalid`` counts repeated, unknown and bad-target outcomes.
    """
    valid = outcomes.filter(F.col("target").isin("ACKED", "REJECTED"))
    first = earliest_by(valid, ["id"], [*order, "target"], []).select("id", "target")
    counts = outcomes.groupBy("id").agg(F.count("*").alias("_n"))
    j = sent.select("id", F.lit(True).alias("_sent")).join(first.join(counts, "id", "right"), "id", "full")
    state = F.when(F.col("_sent").isNull(), "UNKNOWN").otherwise(F.coalesce("target", F.lit("PENDING")))
    used = F.when(F.col("_sent") & F.col("target").isNotNull(), 1).otherwise(0)
    return j.select("id", state.alias("state"), (F.coalesce("_n", F.lit(0)) - used).alias("n_invalid"))


def report(states: DataFrame) -> DataFrame:
    tracked = F.col("state") != "UNKNOWN"
    return states.agg(
        F.count_if(tracked).alias("total_tracked"), F.count_if(F.col("state") == "PENDING").alias("pending"),
        F.count_if(F.col("state") == "ACKED").alias("acked"), F.count_if(F.col("state") == "REJECTED").alias("rejected"),
        F.sum("n_invalid").alias("invalid_transitions"))


def replayable(rejects: DataFrame, *, limit: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(to run again, given up): rejected records with fewer than ``limit`` attempts go round once more."""
    again = rejects.filter(F.col("attempts") < limit)
    return again.withColumn("attempts", F.col("attempts") + 1), rejects.filter(F.col("attempts") >= limit)


def replay(rejects: DataFrame, transform: Callable[[DataFrame], DataFrame], *, limit: int = MAX_ATTEMPTS
           ) -> tuple[DataFrame, DataFrame]:
    """Run rejected records through ``transform`` again until they pass or have had ``limit`` attempts.

    ``rejects`` have ``attempts`` (not null); ``transform`` sees the attempt it makes there and adds ``error_kind``, null for a
    record that passes. Returns (recovered, given up), both with ``attempts``; records that come with ``limit``
    attempts are given up at once. There are at most ``limit`` passes, each over what still fails, and each is
    written before the next reads it.
    """
    recovered, given_up, left = [], [], rejects
    for _ in range(limit):
        again, done = replayable(left, limit=limit)
        given_up.append(done)
        out = staged(transform(again), "replay")
        recovered.append(out.filter("error_kind is null"))
        left = out.filter("error_kind is not null")
        if left.isEmpty():
            break
    given_up.append(left)

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    return union(recovered), union(given_up)
