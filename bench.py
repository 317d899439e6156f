"""Bench: runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ..., ...}

Each query is forced with the ``noop`` sink (full computation, nothing
collected).  Every headline query first runs once on a smaller test scale (sf0.01)
(not timed) so JVM class loading, code generation and JIT warm-up are not billed to the first
query; the reference's numbers are steady-state latencies too.  Scoring throughput (rows/s) is reported next to the reference's
~219 rows/s batch figure.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "agg4_feature_table",
    "agg2_order_lines_rollup",
    "ev2_ev3_auc_ap",
    "ev9_cost_curve",
    "dr8_drift_report_events",
    "prf7_describe",
    "sc4_batch_score",
    "adp8_align_compact_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from riskframe.plans.catalog import REGISTRY
    from riskframe.session import ensure_checkpoint_dir, local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2)
    ensure_checkpoint_dir(spark)
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            if name in REGISTRY:
                REGISTRY[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    extra: dict[str, float] = {}
    for name in HEADLINE:
        if name not in REGISTRY:
            continue
        t0 = time.time()
        df = REGISTRY[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    if "sc4_batch_score" in times:
        n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
        extra["scoring_rows"] = n
        extra["scoring_rows_per_sec"] = round(n / times["sc4_batch_score"], 1)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else sf_dir, "cpus": int(cpus), **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
