"""Alert timers against a clock of ticks: planned by name, cancelled by run, fired once, suppressed where runs have ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from slipway.functions.ordered import DAY_MS, as_of, earliest_by
from slipway.operators.sla import action_hint
from slipway.schema import FINISHED, RUN_KEY, TERMINAL_EVENTS

NAME_KEY = [*RUN_KEY, "name"]
#: ``since_ms`` of a timer that was planned before all rows at hand.
ALWAYS = -(1 << 52)


def settle(timers: DataFrame, cancels: DataFrame, ticks: DataFrame) -> DataFrame:
    """What becomes of each timer name: ``state`` fired (at tick ``fired_ms``), live or cancelled.

    ``timers``: run key, name, ``since_ms`` (when it was planned), ``ready_ms`` (from when a tick fires it) and any other
    columns; ``cancels``: run key, ``at_ms``; ``ticks``: ``tick_ms``. A plan of a name that is live is skipped; a cancel
    ends the live timers of its run, whose names may then be planned again; the first tick at or after ``ready_ms`` fires,
    after which the name is used up. Of equal times, cancels go before plans and before ticks.

    Plans of a name fall into segments between the cancels of its run, and only the first plan of each counts, so the
    outcome needs two as-of lookups and no walk along a run. Ticks are looked up once per distinct moment: a moment at
    which a third of all timers are due is one row of that lookup.
    """
    moments = timers.select("ready_ms").distinct().select(F.lit(0).alias("_k"), "ready_ms", (-F.col("ready_ms")).alias("_at"))
    clock = as_of(moments, ticks.select(F.lit(0).alias("_k"), (-F.col("tick_ms")).alias("_at"), "tick_ms"), ["_k"],
                  probe_ms="_at", fact_ms="_at", fact_order=[], payload=["tick_ms"], out="_tick", bucket_ms=DAY_MS)
    ends = as_of(timers.withColumn("_at", -F.col("since_ms") - 1), cancels.select(*RUN_KEY, (-F.col("at_ms")).alias("_at"), "at_ms"),
                 RUN_KEY, probe_ms="_at", fact_ms="_at", fact_order=[], payload=["at_ms"], out="_end", bucket_ms=DAY_MS)
    extra = [c for c in timers.columns if c not in [*NAME_KEY, "since_ms"]]
    first = earliest_by(ends.withColumn("_end", F.col("_end.at_ms")), [*NAME_KEY, "_end"], ["since_ms", "ready_ms"],
                        [c for c in extra if c != "ready_ms"])
    j = first.join(clock.select("ready_ms", F.col("_tick.tick_ms").alias("_tick")), "ready_ms", "left")
    fired = F.col("_tick").isNotNull() & (F.col("_end").isNull() | (F.col("_tick") < F.col("_end")))
    j = j.withColumn("fired_ms", F.when(fired, F.col("_tick"))).withColumn("state", F.when(
        F.col("fired_ms").isNotNull(), "fired").when(F.col("_end").isNull(), "live").otherwise("cancelled"))
    rank = F.when(F.col("state") == "fired", 2).when(F.col("state") == "live", 1).otherwise(0)
    kept = F.max_by(F.struct(*extra, "fired_ms", "state"), F.struct(rank, -F.col("fired_ms"), F.col("since_ms"))).alias("_t")
    return j.groupBy(*NAME_KEY).agg(kept).select(*NAME_KEY, "_t.*")


def judge(fired: DataFrame, events: DataFrame, statuses: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Add ``outcome`` (published, finished or late_warning), ``status`` and ``action_hint`` as of ``fired_ms``.

    ``events``: run key, ``event_ms``, seq, event; ``statuses``: run key, ``at_ms``, seq, status (null: unknown).
    ``before`` has what was known of a run earlier: run key, ``event`` and ``status`` as structs (ms, seq, value).
    A run is finished if its latest event ends it or its status says so.
    """
    facts = {"event": events.select(*RUN_KEY, F.col("event_ms").alias("ms"), "seq", F.col("event").alias("value")),
             "status": statuses.select(*RUN_KEY, F.col("at_ms").alias("ms"), "seq", F.col("status").alias("value"))}
    out = fired
    for name, rows in facts.items():
        out = as_of(out, rows, RUN_KEY, probe_ms="fired_ms", fact_ms="ms", fact_order=["seq"],
                    payload=["ms", "seq", "value"], out=f"_{name}")
    if before is not None:
        out = out.join(before.select(*RUN_KEY, F.col("event").alias("_e"), F.col("status").alias("_s")), RUN_KEY, "left")
        out = out.withColumns({"_event": F.greatest("_event", "_e"), "_status": F.greatest("_status", "_s")})
    event, status = F.col("_event.value"), F.coalesce("_status.value", F.lit("not started"))
    finished = F.coalesce(event.isin(*TERMINAL_EVENTS), F.lit(False)) | status.isin(*FINISHED)
    late = (F.col("alert_type") == "SLA_WARNING") & F.coalesce(F.col("fired_ms") >= F.col("breach_ms"), F.lit(False))
    return out.withColumns({
        "outcome": F.when(finished, "finished").when(late, "late_warning").otherwise("published"),
        "status": status, "action_hint": action_hint(status, F.col("alert_type")),
    }).drop("_event", "_status", "_e", "_s")
