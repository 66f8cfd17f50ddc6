"""Gapless positions inside groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one repeated row is expanded into by a single task.
EXPAND_ROWS = 65536


def ranked(rows: DataFrame, group: list[str], order: list[str], cell: Column) -> DataFrame:
    """``rows`` with ``_rank`` (long, gapless from 0 within ``group``).

    ``order`` names every column that tells rows apart; rows equal in all of them are
    interchangeable and are counted before the shuffle, so a row repeated in a third of
    the table costs one record.  ``cell`` must grow with ``order`` (or split the group by
    a hash): positions are taken inside a cell, and a running sum of the cells' counts
    gives each cell its offset.  Nulls sort first.  Empty input gives an empty result.
    """
    keys = [*group, *order]
    counted = rows.withColumn("_cell", cell).groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_copies"))
    within = (Window.partitionBy(*group, "_cell").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = counted.withColumn("_local", F.sum("_copies").over(within) - F.col("_copies"))
    cells = counted.groupBy(*group, "_cell").agg(F.sum("_copies").alias("_rows"))
    before = (Window.partitionBy(*group).orderBy("_cell")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = cells.withColumn("_offset", F.sum("_rows").over(before) - F.col("_rows"))
    offsets = offsets.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                             F.col("_cell").alias("_c"), "_offset")
    on = F.col("_cell").eqNullSafe(F.col("_c"))
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    placed = local.join(offsets, on)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(EXPAND_ROWS).cast("long")))
    one = F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + EXPAND_ROWS, F.col("_copies")) - 1))
    return (placed.withColumn("_chunk", chunk).withColumn("_i", one)
            .select(*keys, (F.col("_offset") + F.col("_local") + F.col("_i")).alias("_rank")))
