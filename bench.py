"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "feature_table", "summarize_history", "two_hop", "payment_flags", "recency_window", "best_so_far", "rolling_mean", "stratified_split", "auc_by_variable", "psi", "ks", "correlations",
    "missingness_test", "ranking_metrics", "best_thresholds", "calibration_error", "delong", "friedman", "newey_west", "nearest_neighbours", "naive_bayes_scores", "smote",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from gneiss import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # JVM warm-up
    for name in HEADLINE:
        if name in queries:
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    sys.exit(main())
