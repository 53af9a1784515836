"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["momentum_panel", "annual_features_1", "annual_industry_adjusted", "quarterly_features", "monthly_features", "daily_month_features", "rolling_beta", "residual_variance_three_factors", "announcement_features", "asof_several", "merge_features", "research_panel", "excess_returns", "spearman_summary", "match_rates", "benchmark_movement"]


def main() -> None:
    from pyspark.sql import SparkSession

    from panelwright.plans import catalog

    cpus, where = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found, took = catalog.queries(), {}
    found["coverage"](spark, where).collect()  # warm-up
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, where).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": where.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
