"""Headline queries on the given tables; prints one JSON line.

Prepared rows and forecasts are written once, timed under their own names, and read by
the evaluation queries, as in normal use. Each query runs once, without a warm-up run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sunledger.queries import QUERIES  # noqa: E402
from sunledger.queries.base import Given  # noqa: E402
from sunledger.session import build_session  # noqa: E402

HEADLINE = [
    "rollup_mean", "numeric_summary", "outlier_profile", "coverage_summary", "missingness",
    "interpolate_both", "impute_reference", "robust_bounds", "irradiance_summary", "flatlines",
    "solar_position", "feature_table", "weather_regimes", "lookback_windows", "persistence_forecasts",
    "forecast_scores", "point_metrics", "stratified_metrics", "conformal_widths", "coverage_table",
    "bootstrap_skill", "diebold_mariano", "signed_ranks_by_row", "autocorrelation",
    "model_comparison", "permutation_importance", "transfer_scores", "registry_upsert",
    "result_matrix", "linear_regression_windows", "gradient_boosting_windows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    given, times = Given(spark, folder), {}
    for name, stage in {"prepare_rows": given.sky, "prepare_forecasts": given.predictions}.items():
        start = time.perf_counter()
        stage().count()
        times[name] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
