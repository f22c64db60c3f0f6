"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = (
    "flagship_trending_propagation", "a1_daily_counts", "a3_propagation", "w1_growth", "w6_rolling_anomaly", "w7_change_points", "w13_lag_correlation",
    "t2_trend_metrics", "t6_forecast_linear", "t8_forecast_ar", "t5_decompose", "j7_co_sharing", "j8_followed_within", "x1_keywords", "x3_tfidf",
    "x7_key_phrases", "s9_extract_page", "g2_propagation_graph", "j10_nearest_centroid", "k27_ensemble_vote", "l4_alert_priority", "s19_s20_evidence",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from storyweft.plans import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.local.dir", local).config("spark.checkpoint.dir", f"file://{local}/checkpoints").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # compile once
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
