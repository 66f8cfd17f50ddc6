"""Prefix sums inside groups of any size, over an order that Spark's range partitioning lays out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakestone.session import scratch_path

#: Copies of one repeated row that a single task writes out.
EXPAND_ROWS = 65536


def laid(rows: DataFrame, group: list[str], order: list[str], weight: Column | None = None) -> DataFrame:
    """(group, order, ``_copies``, ``_start``): the distinct rows in order, and the weight of all rows before each in its group.

    ``group`` and ``order`` name all columns of ``rows``; equal rows are counted first, so a row
    repeated in a third of the table is one record, whose copies follow each other.  ``weight``
    (default 1) is one row's.  Nulls sort first and are a group of their own.  The distinct
    rows are sorted by range partitioning and written, so every later read has the same parts;
    sums run inside a (group, part), which is never more than a part, and the parts' totals
    give each its offset.
    """
    spark = rows.sparkSession
    counted = rows.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_copies"))
    path = scratch_path(spark, "laid")
    (counted.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
     .withColumn("_weight", F.col("_copies") * (F.lit(1) if weight is None else weight)).write.parquet(path))
    placed = spark.read.parquet(path)
    within = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy(*group, "_part").agg(F.sum("_weight").alias("_sum"))
             .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"),
                     F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")))
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(parts, on).select(*group, *order, "_copies", (F.col("_offset") + F.col("_local")).alias("_start"))


def spread(runs: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row for each copy of what :func:`laid` returns, with its own ``_start``.

    Long runs are cut into chunks that are dealt anew before they are written out.
    """
    step = F.lit(EXPAND_ROWS).cast("long")
    each = F.lit(1).cast("long") if weight is None else weight
    chunks = (runs.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, step)))
              .repartition("_start", "_chunk"))
    copy = F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + step, F.col("_copies")) - 1))
    return (chunks.withColumn("_i", copy).withColumn("_start", F.col("_start") + F.col("_i") * each)
            .drop("_chunk", "_i", "_copies"))
