"""Mergeable states of grouped summaries: a new batch is added without rereading the old ones.

A state row holds, per group, the number of rows and, per column, count, sum, sum of squared
deviations from the mean, minimum and maximum; two of them combine exactly to that of both
batches.  Distinct counts keep their values: of whole numbers and dates as bitmaps of 32,768
neighbouring values, which combine by OR, of other types as rows.  States are stored by
batch, so a batch that is delivered again replaces its own state and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType

from lakestone.operators.summarize import Measure, key_column, order_columns, rounded

#: Names of the two state tables, and of the column that partitions them.
VALUES, DISTINCT, BATCH = "values", "distinct", "batch"


def _split(measures: Sequence[Measure]) -> tuple[list[str], list[Measure]]:
    """Columns that need moments or extremes, and the distinct counts."""
    columns = [m.column for m in measures if m.column and m.agg != "count_distinct"]
    return list(dict.fromkeys(columns)), [m for m in measures if m.agg == "count_distinct"]


def value_state(df: DataFrame, keys: Sequence, measures: Sequence[Measure]) -> DataFrame:
    """One row a group: keys, ``__rows`` and a struct of moments and extremes for each column."""
    columns, _ = _split(measures)
    parts = [F.struct(F.count(c).alias("n"), F.sum(F.col(c).cast("double")).alias("sum"),
                      (F.var_pop(c) * F.count(c)).alias("m2"), F.min(c).alias("min"), F.max(c).alias("max")).alias(f"__v{i}")
             for i, c in enumerate(columns)]
    return df.groupBy(*[key_column(k) for k in keys]).agg(F.count(F.lit(1)).alias("__rows"), *parts)


def _combined(a: Column, b: Column) -> Column:
    """The moments and extremes of both batches (Chan's rule for the squared deviations); empty ones change nothing."""
    n = a["n"] + b["n"]
    gap = b["sum"] / b["n"] - a["sum"] / a["n"]
    both = F.struct(n.alias("n"), (a["sum"] + b["sum"]).alias("sum"),
                    (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"),
                    F.least(a["min"], b["min"]).alias("min"), F.greatest(a["max"], b["max"]).alias("max"))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def merge_values(states: DataFrame, key_names: Sequence[str]) -> DataFrame:
    """One state row a group from those of any number of batches.

    A group's rows (one a batch) are put into one order before they are combined, so the
    result does not depend on how they were shuffled.
    """
    parts = [c for c in states.columns if c.startswith("__v")]
    listed = states.groupBy(*key_names).agg(F.sum("__rows").alias("__rows"),
                                            *[F.array_sort(F.collect_list(c)).alias(c) for c in parts])
    return listed.withColumns({c: F.reduce(F.slice(c, 2, F.size(c)), F.element_at(c, 1), _combined) for c in parts})


def _bits_of(df: DataFrame, m: Measure) -> Column | None:
    """A whole number that stands for the column's value, or None where it has no such form."""
    kind = df.schema[m.column].dataType
    if isinstance(kind, DateType):
        return F.unix_date(m.column).cast("long")
    return F.col(m.column).cast("long") if isinstance(kind, IntegralType) else None


def distinct_state(df: DataFrame, keys: Sequence, measures: Sequence[Measure]) -> DataFrame | None:
    """(keys, ``__m``, ``__bucket``, ``__bits``, ``__value``): the distinct values of each distinct count.

    Values are made distinct before they are dealt to bitmaps, so a group of a third of
    all rows sends each value once a task, and a bitmap is built from 32,768 values at most.
    """
    _, counted = _split(measures)
    if not counted:
        return None
    key_cols = [key_column(k) for k in keys]
    names = df.select(*key_cols).columns
    entries = []
    for i, m in enumerate(counted):
        bits = _bits_of(df, m)
        value = F.col(m.column).cast("string") if bits is None else F.lit(None).cast("string")
        entries.append(F.struct(F.lit(i).alias("__m"), (F.lit(None).cast("long") if bits is None else bits).alias("__bit"),
                                value.alias("__value")))
    rows = (df.select(*key_cols, F.inline(F.array(*entries))).where(F.coalesce(F.col("__bit").cast("string"), F.col("__value")).isNotNull())
            .distinct())
    whole = (rows.where(F.col("__bit").isNotNull())
             .select(*names, "__m", F.bitmap_bucket_number("__bit").alias("__bucket"), F.bitmap_bit_position("__bit").alias("__at"))
             .repartition(*names, "__m", "__bucket").groupBy(*names, "__m", "__bucket")
             .agg(F.bitmap_construct_agg("__at").alias("__bits")))
    return (whole.withColumn("__value", F.lit(None).cast("string"))
            .unionByName(rows.where(F.col("__bit").isNull())
                         .select(*names, "__m", F.lit(None).cast("long").alias("__bucket"),
                                 F.lit(None).cast("binary").alias("__bits"), "__value")))


def distinct_counts(states: DataFrame, key_names: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """(keys, one exact count for each distinct count) from the states of any number of batches."""
    _, counted = _split(measures)
    whole = (states.where(F.col("__bits").isNotNull()).groupBy(*key_names, "__m", "__bucket")
             .agg(F.bitmap_count(F.bitmap_or_agg("__bits")).alias("__n")))
    other = states.where(F.col("__bits").isNull()).select(*key_names, "__m", "__value").distinct()
    counts = (whole.select(*key_names, "__m", "__n")
              .unionByName(other.select(*key_names, "__m", F.lit(1).cast("long").alias("__n"))))
    return counts.groupBy(*key_names).agg(
        *[F.coalesce(F.sum(F.when(F.col("__m") == i, F.col("__n"))), F.lit(0)).cast("long").alias(m.name)
          for i, m in enumerate(counted)])


def finished(values: DataFrame, distinct: DataFrame | None, key_names: Sequence[str], measures: Sequence[Measure],
             order: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The summary that ``summarize`` gives over all batches, from their states."""
    columns, counted = _split(measures)
    merged = merge_values(values, key_names)
    if counted:
        counts = distinct_counts(distinct, key_names, measures)
        on = F.lit(True)
        for k in key_names:
            counts = counts.withColumnRenamed(k, f"__k_{k}")
            on &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        merged = merged.join(counts, on, "left")
    out = []
    for m in measures:
        if m.agg == "count":
            out.append(F.col("__rows").cast("long").alias(m.name))
        elif m.agg == "count_distinct":
            out.append(F.coalesce(F.col(m.name), F.lit(0)).cast("long").alias(m.name))
        else:
            part = f"__v{columns.index(m.column)}"
            s = F.col(part)
            kind = values.schema[part].dataType["min"].dataType
            value = {"count_nonnull": s["n"], "sum": s["sum"], "min": s["min"], "max": s["max"],
                     "avg": F.when(s["n"] > 0, s["sum"] / s["n"]),
                     "stddev": F.when(s["n"] > 1, F.sqrt(s["m2"] / (s["n"] - 1)))}[m.agg]
            out.append(rounded(value, m, kind).alias(m.name))
    table = merged.select(*key_names, *out)
    return table.orderBy(*order_columns(order, key_names)) if order else table


def add_batches(df: DataFrame, spec: tuple, folder: str, batch: Column) -> None:
    """Write the states of ``df`` under ``folder``, by ``batch``; they replace what these batches had before."""
    keys, measures, _ = spec
    keys = [*keys, batch.alias(BATCH)]
    for name, state in ((VALUES, value_state(df, keys, measures)), (DISTINCT, distinct_state(df, keys, measures))):
        if state is not None:
            (state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(BATCH).parquet(f"{folder.rstrip('/')}/{name}"))


def from_batches(spark: SparkSession, spec: tuple, folder: str) -> DataFrame:
    """The summary over all batches under ``folder``."""
    keys, measures, order = spec
    names = [k if isinstance(k, str) else k[0] for k in keys]
    values = spark.read.parquet(f"{folder.rstrip('/')}/{VALUES}")
    distinct = spark.read.parquet(f"{folder.rstrip('/')}/{DISTINCT}") if _split(measures)[1] else None
    return finished(values, distinct, names, measures, order)
