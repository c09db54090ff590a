"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Each query is planned, fitted (model queries run their fitting jobs while being built) and fully materialised
through the ``noop`` sink, so the time covers every job the query needs without collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabwise.plans import QUERIES  # noqa: E402
from tabwise.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tabwise-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not attributed to a query
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 — report and continue with the other queries
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"# {name}: {times.get(name, 'FAILED')}", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else None, "cpus": cpus, "n_queries": len(times)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
