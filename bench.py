"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Each query writes all
of its rows to a sink that discards them, so nothing is pruned away and nothing is collected.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "leaderboard_rank", "error_band", "air_density", "multi_level_wind", "grid_stats", "idw_group_feature",
    "ldaps_group_idw", "gfs_group_idw", "forecast_feature", "dataset_builder", "scada_interpolation", "turbine_hourly",
    "group_hourly", "median_impute", "empirical_power_curve", "time_split", "persistence_lag1", "affine_calibration",
    "calibration_audit", "blend_weight",
]


def main() -> None:
    from zephyrgrid.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    from zephyrgrid.plans.queries import QUERIES
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
