"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion into Spark's ``noop`` sink (full execution,
nothing collected).  One warm-up run of the flagship on the smallest fixture absorbs JVM and
Python-worker start-up.  Prints
one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "enrich_tickets",          # flagship: clean -> language -> intents -> urgency -> reply
    "urgency_by_language",
    "detect_language",         # whole documents
    "rank_intents",
    "metrics_report",
    "latency_stats",
    "recent_escalations",
    "evaluate",
    "stratified_split",
    "prepare_combined_dataset",
    "augment_languages",
    "render_reply",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ticketflow.session import local_session
    from ticketflow.plans.queries import REGISTRY

    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16,
                          app_name="ticketflow-bench")
    # warm-up on the smallest fixture (other data: JIT, codegen and Python
    # workers only, no reuse of results)
    warm = "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir
    REGISTRY["enrich_tickets"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    n_tickets = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).count()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_total_time",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
        "enrich_tickets_per_sec": round(n_tickets / times["enrich_tickets"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
