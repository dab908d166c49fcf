"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "B1_filter_category",
    "B2_enrich",
    "C1_comparison_pool",
    "D1_focal_prepost",
    "D2_donor_prepost",
    "H1_pair_features",
    "E3_zscores",
    "G1_new_upcs",
    "G2_classify_new",
    "G3_ramp_monitor_16w",
    "H7_rate_weekly",
    "H11_win_association",
    "I2_pack_ladder",
    "I4_price_windows",
    "D9_pack_norms",
    "D10_category_norms",
    "I7_driver_features",
    "C3_competitive_pool",
    "H6_pool_scope",
    "J1_forecast_panel",
    "J11_recursive_rule",
    "J17_portfolio_constraint",
    "L3_rolling_cv",
    "L11_ks_shift",
    "A10_dedup_latest",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfwise-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from shelfwise.plans import catalog

    queries = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        # the noop sink computes every column of every row and moves nothing to the driver
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("B1_filter_category")  # start the JVM and warm the file cache
    times = {name: round(run(name), 3) for name in HEADLINES}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
