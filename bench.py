"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from iocscan.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "s3_scan_files", "j1_hash_all", "j1_hash_large_list", "j2_filename_regex", "j3_levenshtein", "j3_levenshtein_scaled",
    "j4_content_literal", "j4_content_regex", "j4_content_many", "a1_count", "a1_at_offset", "a2_match_offsets",
    "json_leaves", "j5_event_leaf_rules", "j6_registry_rules", "s4_expand_roundtrip", "o1_scan_all",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("iocscan-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    # a first pass warms up the JVM and the Python workers
    for measured in (False, True):
        for name in chosen:
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if measured:
                times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "total query time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
