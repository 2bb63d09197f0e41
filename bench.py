"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the local cores. Every
query runs in full into a sink that discards the rows; the time is the median of
the warm runs (BENCH_RUNS, 3 unless set).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from connlens.catalog.queries import all_queries

HEADLINE = [
    "select_conn",
    "conn_by_dns_query",
    "conn_www_sum",
    "totals_proto_service",
    "totals_orig_h_resp_h",
    "totals_all",
    "totals_all_23",
    "totals_stored",
    "results_upsert",
    "orig_h_ranking",
    "enrich_resp_h",
    "lookup_candidates",
    "ddos_features",
    "scan_features",
    "detect_ddos_http",
    "detect_scan_tcp",
    "victim_history",
    "attackers_enriched",
    "pivot_service_hour",
    "pivot_ddos_victims_hour",
    "export_totals_orig_h_resp_h",
    "export_csv_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("connlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    result = {
        "metric": "headline queries, sum of median warm times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
