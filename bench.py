"""Headline-query benchmark.

Runs the headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) with local[$BENCH_CPUS] and
prints ONE JSON line: {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is fully computed with the ``noop`` sink (no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "task1_metrics",          # flagship: all runs scored in one aggregation
    "seed_average_hard",      # seed averaging per item x model x context
    "context_changes",        # context-effect analysis
    "change_summary",
    "seed_summary",           # medians / quartiles over seeds
    "hierarchical_metrics",   # task-3 ICM / hierarchical F / propensity F
    "context_columns",        # thread contexts: windows, root finding, comment joins, news
    "fill_context",
    "preprocess",             # text cleaning over whole documents
    "tfidf",
    "group_disjoint_split",
    "ece",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from threadlens.plans.registry import load_all
    from threadlens.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="threadlens-bench")
    reg = load_all()
    # JVM / codegen warm-up on the smallest tables, not timed
    reg["task1_metrics"].build(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
