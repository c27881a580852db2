"""Benchmark: runs the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the folder of the tables and ``BENCH_CPUS`` the cores. Each
query runs once cold and ``BENCH_RUNS`` (default 2) times warm; the median of the
warm runs counts. Results are written to Spark's noop sink, so every row and
column is computed but nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "event_log_report",
    "trim_text",
    "strip_special_characters",
    "parse_dates",
    "auto_cast_numbers",
    "one_hot_segments",
    "standardize_population",
    "remove_outliers_in_sequence",
    "remove_outliers_jointly",
    "rolling_mean_per_user",
    "rolling_mean_overall",
    "interpolate_overall",
    "forward_fill",
    "resample_hourly_per_type",
    "dedup_exact_subset",
    "dedup_keep_first",
    "dedup_keep_last",
    "dedup_time_window_per_user",
    "dedup_time_window_overall",
    "dedup_numeric_tolerance",
    "dedup_similar_passages",
    "dedup_cosine_documents",
    "validate_rules",
    "orphaned_foreign_keys",
    "table_report",
    "join_tables",
    "group_count",
    "flatten_indexed_paths",
    "csv_read",
    "upsert_orders",
    "partition_orders_by_date",
    "personal_data",
    "classify_documents",
    "strip_html_tags",
    "plan_csv",
    "plan_sensor",
]


def main() -> None:
    from brightrow.session import local_session
    from brightrow.suite import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores))
    spent = {}
    for name in chosen:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        spent[name] = round(statistics.median(times[1:]), 3)
        print(f"{name:32s} {spent[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds_of_headline_queries",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cores),
            }
        )
    )


if __name__ == "__main__":
    main()
