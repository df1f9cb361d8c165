"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query writes to the ``noop`` sink; the reported time is the median of three runs after one warm-up.
``prepare_tables`` is the one-off derivation of the stored control-plane tables. ``store_*`` lines are the tables that the
engine itself keeps (run starts, baselines, arrivals, observation markers), which the queries after them only read.
``LIVE`` lines run whole streaming jobs, timed once after one warm-up. The total covers ``prepare_tables`` and HEADLINE, as
in every round; the other lines stand beside it.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from slipway.plans import decisions, history
from slipway.plans.catalog import QUERIES
from slipway.plans.registry import Tables
from slipway.session import local_session

HEADLINE = [
    "s9_upsert_sensors", "s10_insert_if_absent", "s13_number_reruns", "p4_execution_date", "r9_readiness",
    "r10_trigger_hits", "c1_excluded_time", "l1_absolute_deadline", "l6_fire_alerts", "n1_latest_job_event",
    "n4_rerun_decision", "n5_retry_decision", "n6_late_data", "d1_baselines", "d6_completed_drift", "w1_stale_runs",
    "w4_recovered", "j2_false_success", "j7_readiness_replay", "j8_poll_replay", "e6_alarm_periods", "q1_batch_split",
    "q3_reconcile",
]
LIVE = ["t1_live_triggers", "t5_rerun_decisions"]
KEPT = {"run_starts": history.starts, "baselines": decisions.baselines, "arrivals": decisions.arrivals,
        "dry_markers": history.dry_markers}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, memory="12g", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    start = time.time()
    Tables(spark, sf_dir).store_all()
    times["prepare_tables"] = round(time.time() - start, 3)
    beside: dict[str, float] = {}
    for name, make in KEPT.items():
        start = time.time()
        make(Tables(spark, sf_dir))
        beside[f"store_{name}"] = round(time.time() - start, 3)
    for name in HEADLINE:
        samples = []
        for _ in range(runs + 1):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.time() - start)
        times[name] = round(statistics.median(samples[1:]), 3)
    for name in LIVE:
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            beside[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times | beside,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
