"""Bench: time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced to run completely with the ``noop`` sink (no collect).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "label_counts", "final_reputation", "reputation_trace", "kafka_payload", "capped_experience",
    "zscore", "knn20", "hbos", "loda", "consensus_split", "vote_topn_split", "final_reputation_unsupervised",
    "daily_users", "daily_share", "stage_comparison", "stream_reputation",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from trustfold.plans.catalog import QUERIES
    from trustfold.session import clear_scratch, local_session, ship_package

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="trustfold-bench")
    ship_package(spark)
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    # warm-up, not timed: JVM, the Python worker pool (one tiny mapInPandas per
    # core) and codegen caches; these are per-session start-up costs
    QUERIES["label_events"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
        clear_scratch(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
