"""Run locks with a lifetime: which hits start a run when a lock may run out before the next hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slipway.functions.ordered import as_of, earliest_by
from slipway.schema import LOCK_SECONDS, RUN_KEY
from slipway.session import staged


def lock_acquisitions(hits: DataFrame, held: DataFrame, *, life_s: int = LOCK_SECONDS) -> DataFrame:
    """Hits (run key, ts_ms, seq) that take their run's lock, with the ``ttl_epoch`` second at which it ends.

    A hit takes the lock if its run has none, or if its second is not before the end of the last one. ``held`` has locks
    taken before (run key, ttl_epoch; null: for good), several per run if need be.

    Who takes a lock depends on who took the one before, a chain along the run. Each second's first hit points at the
    first hit after its lock would end, found by an as-of lookup inside time buckets; the chain from the first free
    hit is followed by doubling the pointers, so a run with n locks needs log n joins on (run, second), and no step
    puts a whole run into one task.
    """
    ends = held.groupBy(*RUN_KEY).agg(F.max(F.coalesce("ttl_epoch", F.lit((1 << 63) - 1))).alias("_until"))
    free = hits.select(*RUN_KEY, "ts_ms", "seq").withColumn("sec", F.expr("ts_ms div 1000")).join(
        ends, RUN_KEY, "left").filter("_until is null or sec >= _until")
    nodes = staged(earliest_by(free, [*RUN_KEY, "sec"], ["ts_ms", "seq"], []), "lock-nodes")
    back = as_of(nodes.select(*RUN_KEY, "sec", (-F.col("sec") - life_s).alias("_at")),
                 nodes.select(*RUN_KEY, "sec", (-F.col("sec")).alias("_at")), RUN_KEY, probe_ms="_at", fact_ms="_at",
                 fact_order=[], payload=["sec"], out="_next", bucket_ms=life_s)
    jump = staged(back.filter("_next is not null").select(*RUN_KEY, "sec", F.col("_next.sec").alias("next")), "lock-jumps")
    taken = staged(nodes.groupBy(*RUN_KEY).agg(F.min("sec").alias("sec")), "locks")
    while True:
        more = staged(taken.join(jump, [*RUN_KEY, "sec"]).select(*RUN_KEY, F.col("next").alias("sec")), "locks")
        if more.isEmpty():
            break
        taken = taken.unionByName(more)
        ahead = jump.select(*RUN_KEY, F.col("sec").alias("next"), F.col("next").alias("after"))
        jump = staged(jump.join(ahead, [*RUN_KEY, "next"]).select(*RUN_KEY, "sec", F.col("after").alias("next")), "lock-jumps")
    return taken.join(nodes, [*RUN_KEY, "sec"]).select(*RUN_KEY, "ts_ms", "seq", (F.col("sec") + life_s).alias("ttl_epoch"))
