"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the local cores, BENCH_RUNS (default
1) how often each query runs; the median counts. A first scan of the smallest data starts the JVM and is not counted.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.compare import local_session
from redactlake.plans.queries import queries

HEADLINE = [
    "scan_full",
    "anonymize",
    "candidates_all",
    "det_email",
    "det_phone",
    "det_credit_card",
    "det_iban",
    "det_personal_id",
    "det_address",
    "det_secret",
    "whitelist_filter",
    "placeholder_map",
    "mask_user_messages",
    "scan_summary",
    "dry_run_report",
    "policy_apply",
    "metrics_by_type",
    "log_tail",
    "log_traffic_report",
    "rate_admit",
    "restore",
    "stream_scan",
]


def run(spark, name: str, sf_dir: str) -> float:
    begun = time.perf_counter()
    queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "scan_full", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    timings = {
        name: round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3) for name in HEADLINE
    }
    result = {
        "metric": "pii_scan_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
