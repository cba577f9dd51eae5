"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "b06_record_matching", "b07_isolation_forest", "c02_unit_rollup", "d03_kaplan_meier", "d09_hazard_backtest",
    "d15_headcount_summary", "e03_wage_bill", "e10_benefit_run_off", "e12_fund_ledger", "f04_fan_long", "f09_depletion_curve",
    "f12_package_objectives", "f13_pareto_front", "g03_unit_wave_table", "g05_explain_gap", "h10_score_rolling",
    "i08_hierarchy_backtest", "i07_mint_shrink", "j09_risk_scores", "k06_auc", "l01_tfidf_search", "l05_grounding_check",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("rollcall-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
             # small local shuffles should still use every core
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from rollcall.plans.catalog import QUERIES
    only = sys.argv[1:]
    # one small job first, so that no query pays for starting the engine
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    times = {}
    for name in HEADLINE:
        if only and not any(name.startswith(p) for p in only):
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
