"""Benchmark the registered ledger questions.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric", "value" (sum of query seconds), "unit",
"queries": {name: seconds}, "sf"}.  Each query is executed in full (a no-op
sink forces every row of the result) after a warm-up pass (smallest tables,
then one untimed run at the measured scale); the time is the best of
``BENCH_REPEAT`` runs (default 2).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerlens.plans.registry import QUERIES  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402

WARMUP_DIR = "/root/testdata/sf0.001"


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = only or list(QUERIES)
    spark = local_session(cores=cpus, shuffle_partitions=cpus, app="ledgerlens-bench")

    # warm JVM: generated code compiled on the small tables, then one untimed
    # run per question at the measured scale so the JIT has optimised the hot
    # loops before timing
    if os.path.isdir(WARMUP_DIR):
        for name in names:
            run(QUERIES[name](spark, WARMUP_DIR))
    for name in names:
        run(QUERIES[name](spark, sf_dir))

    times: dict[str, float] = {}
    for name in names:
        best = float("inf")
        for _ in range(max(1, repeat)):
            t0 = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            best = min(best, time.perf_counter() - t0)
        times[name] = round(best, 3)
    spark.stop()

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "ledger_questions_total_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
