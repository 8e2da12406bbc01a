"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import time

from kerbline.session import local_session
from kerbline.workload.queries import QUERIES

HEADLINE = (
    "rank_routes",
    "score_routes",
    "score_bikeways",
    "score_one_bikeway",
    "log_score_bikeways",
    "tiles_on_route",
    "crash_tiles",
    "top_tiles",
    "crash_weights",
    "hazard_categories",
    "load_crash",
    "load_hazard",
    "merge_crash",
    "incremental_load",
    "hazard_alert",
)

WARM_UP = ("rank_routes", "score_routes", "load_crash")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        # Load classes and compile code on the smallest data, untimed.
        for name in WARM_UP:
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    routes = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, planning and execution",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "routes_scored_per_sec": round(routes / seconds["score_routes"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
