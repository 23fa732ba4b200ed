"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.  Each query runs
once to warm up and once timed; the result is fully computed and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablescout.plans.queries import QUERIES  # noqa: E402
from tablescout.session import build_session  # noqa: E402

HEADLINE = (
    "s3_parquet_scan", "p9_dedup_keep_first", "p11_flag_outliers", "a3_numeric_summary", "a4_categorical_summary", "a6_distinct_counts",
    "a8_duplicate_rows", "a20_grouped_aggregates", "a22_pivot_table", "a25_daily_series", "r5_value_overlap", "r8_confidence", "j1_star_join",
    "k18_kpi_report", "k20_kpi_by_period", "w1_cumulative_sum", "w2_rolling_mean", "w4_forward_fill", "u6_append_dedup", "m1_zscore_anomalies",
    "m2_iqr_anomalies", "m3_isolation_anomalies", "m9_anomaly_scan", "m11_correlations", "m14_linear_trend", "m16_impact", "m29_forecast_all",
    "m31_granger_all_lags", "m37_linear_drivers", "m39_categorical_drivers", "e5_top_matches", "e6_similar_pairs", "i1_extract_findings",
    "c6_top_customers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    times, cold = {}, {}
    for name in chosen:
        for record in (cold, times):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            record[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "cold": cold, "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus, "queries_run": len(times)}))


if __name__ == "__main__":
    main()
