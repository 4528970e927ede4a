"""Time the headline queries: one JSON line on stdout.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores), BENCH_RUNS (timed runs).
Each query is run to the end without collecting rows. One query that is not timed starts the session; with several runs
one more of each query warms up and the median counts.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = [
    "group_files", "group_manifest_merge", "batch_numbers", "normalize_keys", "valid_keys", "to_cells", "key_counts",
    "header_union", "field_samples", "merge_header", "detect_conflicts", "merge_nested", "merge_flat", "number_rows",
    "resolve_template", "pivot_wide", "flatten_hyphen", "latest_results", "best_results", "pending_files",
    "overlay_retry", "csv_escape", "private_hosts", "parse_response", "validate_flat", "validate_schema_guided",
    "merge_prompt", "extract_documents", "run_report",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docmerge-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from docmerge.queries import queries

    queries()["group_files"](spark, sf).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name, query in queries().items():
        if name not in (only or HEADLINE):
            continue
        took = []
        for i in range(runs + (runs > 1)):
            start = time.perf_counter()
            query(spark, sf).write.format("noop").mode("overwrite").save()
            if i or runs == 1:
                took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(sf.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
