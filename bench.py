"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query runs its full plan into a ``noop`` sink (nothing is collected to the
driver); one warm-up, then the median of $BENCH_REPEAT runs.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))

HEADLINE = [
    "nightly_conditions", "sensor_summary", "observations_by_instrument", "quality_report",
    "flagged_rows", "silver_lineitem", "silver_events", "rule_duplicate_key", "scenario_stats",
    "baseline_relative", "weighted_scorecard", "heavy_transform", "injected_events",
]


def _sf(path: str) -> str:
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    return tail[2:] if tail.startswith("sf") else tail


def main() -> None:
    from pyspark.sql import functions as F

    from lakestone.operators.transform import heavy_transform
    from lakestone.plans import driver_queries as Q
    from lakestone.session import get_spark, scratch_path

    spark = get_spark(f"local[{CPUS}]", shuffle_partitions=max(8, CPUS * 2),
                      extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                             "spark.driver.memory": "16g",
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="lakestone-bench-")})
    spark.sparkContext.setLogLevel("ERROR")

    def lineitem_transform(spark, sf_dir):
        # The per-row transform over every lineitem row (600k rows at sf0.1).
        from lakestone.operators.partitioning import spread
        li = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).select(
            F.col("l_suppkey").alias("user_id"), F.col("l_returnflag").alias("category"),
            F.col("l_extendedprice").alias("value"), F.col("l_orderkey").cast("string").alias("text"))
        return heavy_transform(li)

    def medallion_run(spark, sf_dir):
        from lakestone.plans import medallion as M
        runinfo = M.run(spark, Q.events_sources(sf_dir), Q.events_golds(), scratch_path(spark, "bench_medallion"))
        return M.run_summary(spark, runinfo)

    jobs = {name: Q.QUERIES[name] for name in HEADLINE}
    jobs["transform_lineitem"] = lineitem_transform
    jobs["medallion_run"] = medallion_run

    def observatory_pipeline(spark, sf_dir):
        # The source system's own pipeline: generate raw CSV + NDJSON with injected errors
        # (one reading and one event per events row), bronze, silver with the 13 rules,
        # the three gold tables.
        from lakestone.plans import medallion as M
        return M.run_summary(spark, Q.observatory_run(spark, sf_dir)[0])

    jobs["observatory_pipeline"] = observatory_pipeline

    timings = {}
    for name, fn in jobs.items():
        runs = []
        for k in range(REPEAT + 1):
            t0 = time.perf_counter()
            fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if k > 0:
                runs.append(dt)
        timings[name] = round(statistics.median(runs), 4)
        print(f"{name}: {timings[name]:.3f}s", file=sys.stderr)
    total = round(sum(timings.values()), 4)
    print(json.dumps({"metric": "headline_queries_total_median", "value": total, "unit": "sec",
                      "queries": timings, "sf": _sf(SF_DIR), "cpus": CPUS, "repeat": REPEAT}))
    spark.stop()


if __name__ == "__main__":
    main()
