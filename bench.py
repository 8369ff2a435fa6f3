"""Time the headline queries on the generated tables and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8). Each query runs to completion into Spark's no-op sink, so the
whole result is computed without pulling it to the driver. Every query runs
once untimed; then the median of three runs counts (one run, if the first
took longer than SHORT_S seconds).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfspark.plans.registry import queries  # noqa: E402
from shelfspark.session import build_session  # noqa: E402

SHORT_S = 8.0

HEADLINE = [
    "channel_stock", "clean_stock", "dashboard", "dashboard_priced", "dashboard_publish", "kpi", "items_page", "orphan_stock",
    "catalog_sync", "stock_snapshots", "overlay_stock", "actions_items", "actions_catalog", "actions_summary",
    "import_result", "import_summary", "reconcile", "row_fields", "audit_daily", "refresh_dashboard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus, app_name="shelfspark-bench",
                          java_options=os.environ.get("BENCH_JAVA_OPTS"))
    qs = queries()
    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    times: dict[str, float] = {}
    for name in HEADLINE:
        warm = run(name)  # class loading, JIT, published tables - not counted
        times[name] = round(median(run(name) for _ in range(3 if warm < SHORT_S else 1)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
