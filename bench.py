"""Times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "report_buckets", "report_filtered", "deep_offset", "pricing_summary", "shipping_priority", "inner_join_chain", "as_of_join", "range_join", "window_ranks",
    "state_at_latest", "state_at_instant", "snapshot_as_of", "merge_dedup", "latest_per_pk", "key_change_state", "net_changes", "delta_chain_state", "locate_changed",
    "reversal_statements", "multiset_difference", "version_diff", "coverage_gaps", "user_sessions",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from chronolake.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(3):  # the first run compiles
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
