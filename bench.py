"""Benchmark: headline analyses at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up, then `BENCH_REPS` timed runs (median). A run
executes the whole plan through the no-op sink (no collect to the driver).
Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "stance_by_council",
    "topic_frequency",
    "topic_cooccurrence",
    "box_sentiment_by_topic",
    "comments_with_centroid",
    "haversine_distance",
    "lsoa_spatial_join",
    "regression_bootstrap_band",
    "describe_distance",
    "kde_sentiment",
]


def run(spark, fn, sf_dir) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    from civiclens.plans.catalog import QUERIES
    from civiclens.session import build_session
    spark = build_session(cpus)
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        run(spark, QUERIES[name], sf_dir)
        times[name] = round(statistics.median(run(spark, QUERIES[name], sf_dir) for _ in range(reps)), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "reps": reps}))


if __name__ == "__main__":
    main()
