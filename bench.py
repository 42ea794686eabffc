"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from seqlake.queries import QUERIES

HEADLINE = ("latest_state", "snapshot_state", "range_scan", "get_many", "compact_bottom", "dedup_orders", "bulk_sequences", "updates_since", "overlap_groups", "k_way_merge")


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(3):  # the first run compiles
            start = time.perf_counter()
            QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, best of three", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": data.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
