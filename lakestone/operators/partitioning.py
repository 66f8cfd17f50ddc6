"""Partition-count guard for CPU-heavy per-row work.

A table stored as a few large Parquet row groups scans as a few tasks, so a costly
per-row projection (trigonometry, SHA-256 draws) would run on a few cores.  ``spread``
round-robins such an input over the cluster's cores.  On a large input that already
scans as many tasks (the normal case at scale) it does nothing, so no shuffle is added.
Call it on a DataFrame fresh from a read: the partition count is then planning
metadata, and no job runs to find it.
"""

from __future__ import annotations

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """``df`` over at least ``min_partitions`` (default: one for each core) partitions."""
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except PySparkNotImplementedError:  # Spark Connect has no RDDs: leave the plan as is
        return df
    if current >= target:
        return df
    # Round-robin; Spark sorts each input partition first, so a retried task sends
    # every row to the same target again (deterministic under executor loss).
    return df.repartition(target)
