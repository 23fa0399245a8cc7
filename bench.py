"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from lattica.plans import catalog

HEADLINE = ("hist_grouped", "hist_1d", "hist_uneven", "hist_2d", "bins_reduce", "groupby_sum", "groupby_mean", "groupby_min_max", "reduce_all", "cumsum", "sort_by_coord", "arithmetic_variances", "math_functions", "lookup_histogram", "lookup_previous", "bins_times_lookup", "asof_join_events", "rebin_hist", "transform", "vectors")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))


if __name__ == "__main__":
    main()
