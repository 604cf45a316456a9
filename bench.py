"""Times headline queries; prints one JSON line. BENCH_SF_DIR: tables, BENCH_CPUS: threads, BENCH_QUERIES: names."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from keyfold.queries import QUERIES

HEADLINE = [f"q{k}" for k in range(1, 23)]
HEADLINE += ["json_group_count", "json_count_distinct_by_type", "json_hour_histogram", "json_first_event", "json_activity_span", "group_nested", "join_many_to_many", "column_sum", "dot_product"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, planned = {}, {}
    for name in names:
        QUERIES[name](spark, sf_dir).collect()  # compiles code and warms the page cache, as the reference's harness does
        began = time.perf_counter()
        query = QUERIES[name](spark, sf_dir)
        planned[name] = round(time.perf_counter() - began, 3)
        query.collect()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "of it building the plan": planned, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    sys.exit(main())
