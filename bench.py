"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is run once to warm up and then timed as the median of BENCH_RUNS runs; its
whole result is written to Spark's no-op sink.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from marquee.plans.catalogue import QUERIES

HEADLINE = (
    "scan_month", "search_api", "facet_filter", "blacklist_filter", "page_n", "sorted_listing", "city_stats", "artist_stats",
    "normalize_title", "artist_routing", "apply_extraction", "events_transform", "calendar_grid", "holiday_status", "dup_pairs",
    "first_match", "new_rows_anti", "enrich_artist", "merge_full", "upsert_keep_last", "dedup_keep_last", "tree_flatten",
    "project_source_b", "status_transitions",
)


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
