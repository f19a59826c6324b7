"""Time the headline queries. Reads BENCH_SF_DIR and BENCH_CPUS, prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from flightloom.session import build_session
from flightloom.workload import all_queries

HEADLINE = (
    "track_summary route_history flight_target every_nth_point track_realign typical_flight synthetic_tracks "
    "bucket_exposure_sum calendar_features hourly_profile_by_key metar_parse weather_stats normalize_space dedupe_first "
    "polygon_area_centroid storm_exposure_point storm_exposure_flight points_in_polygon proximity_components "
    "describe corr_matrix swarm_layout label_codes linreg_fit training_features"
).split()


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    run(queries["track_summary"](spark, sf_dir))  # start-up and code generation are not the query's time
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        run(queries[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
