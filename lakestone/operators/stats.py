"""Statistics over measurement tables: group stats, pattern ratios, scaling metrics.

All of these aggregate first and only then combine small results; any "baseline" is a
one-row aggregate joined by broadcast (its size is one row by construction).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestone.functions.numeric import round_half_away


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_non_null(value, order) -> Column:
    """The first non-NULL ``value`` in ``order`` (deterministic "first" of a group)."""
    value = _col(value)
    return F.min_by(value, F.when(value.isNotNull(), _col(order)))


def group_stats(df: DataFrame, keys: Sequence[str], value: str, order: str | None = None,
                prefix: str | None = None, scale: int | None = None,
                rows_name: str | None = None) -> DataFrame:
    """Named statistics per group: mean, sample std, non-NULL count, first non-NULL
    (and the row count when ``rows_name`` is given), all in one aggregate.

    Rows with a NULL key are left out (they form no group), keys come out sorted.
    """
    p = prefix if prefix is not None else value
    r = (lambda c: round_half_away(c, scale)) if scale is not None else (lambda c: c)
    aggs = [r(F.avg(value)).alias(f"{p}_mean"),
            r(F.stddev_samp(value)).alias(f"{p}_std"),
            F.count(value).cast("long").alias(f"{p}_count")]
    if order is not None:
        aggs.append(first_non_null(value, order).alias(f"{p}_first"))
    if rows_name:
        aggs.append(F.count(F.lit(1)).cast("long").alias(rows_name))
    kept = df.filter(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))) if keys else df
    return kept.groupBy(*keys).agg(*aggs).orderBy(*[F.col(k).asc() for k in keys])


def scalars(df: DataFrame, **values: Column) -> Column:
    """Aggregates of ``df`` as one struct scalar.

    It also reads every column, so an aggregate that ``df`` ends in is planned as it is in
    the main query, and its shuffle is reused: the fact table is scanned once.
    """
    whole = F.max(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("whole")
    return df.select(F.struct(*[v.alias(k) for k, v in values.items()], whole)).scalar()


def with_bounds(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Attach the global min/max of ``column`` to every row (one scalar subquery)."""
    p = prefix or column
    both = scalars(df, lo=F.min(column), hi=F.max(column))
    return df.withColumns({f"{p}_min": both["lo"], f"{p}_max": both["hi"]})


def pattern_ratio(df: DataFrame, size: str, scenario: str, value: str,
                  numerator: str, denominator: str, ratio_name: str = "ratio") -> DataFrame:
    """Mean ``value`` per (size, scenario) pivoted to columns, then numerator/denominator.

    The pivot values are given, so Spark does not run a distinct job to find them.
    """
    wide = (df.groupBy(size).pivot(scenario, [numerator, denominator]).agg(F.avg(value)))
    return wide.withColumn(ratio_name, F.col(numerator) / F.col(denominator))


def coefficient_of_variation(value) -> Column:
    """Sample standard deviation over mean."""
    return F.stddev_samp(_col(value)) / F.avg(_col(value))


def conditional_mean(value, condition: Column) -> Column:
    """Mean of ``value`` over the rows where ``condition`` holds (NULL elsewhere)."""
    return F.avg(F.when(condition, _col(value)))


def scaling_table(df: DataFrame, p: str = "p", time: str = "time_s", t1: Column | None = None) -> DataFrame:
    """Speedup, efficiency and overhead of each run against the smallest ``p``.

    T1 is the time of the smallest p (a scalar, or ``t1`` where the caller has it).  speedup = T1/Tp,
    efficiency = speedup/p, overhead = Tp - T1/p, useful = Tp - overhead.
    """
    t1 = scalars(df, t=F.min_by(F.col(time), F.col(p)))["t"] if t1 is None else t1
    return (df.withColumn("speedup", t1 / F.col(time))
            .withColumn("efficiency", F.col("speedup") / F.col(p))
            .withColumn("overhead_s", F.col(time) - t1 / F.col(p))
            .withColumn("useful_time_s", F.col(time) - F.col("overhead_s"))
            .orderBy(p))


def quadratic_reference(df: DataFrame, n: str, t: str, exponent: float = 2.0,
                        name: str = "t_pred") -> DataFrame:
    """Reference curve ``t_ref * (n / n_ref) ** exponent`` from the smallest n."""
    ref = scalars(df, n=F.min(n), t=F.min_by(F.col(t), F.col(n)))
    return df.withColumn(name, ref["t"] * F.pow(F.col(n) / ref["n"], F.lit(exponent)))


def reference_curve(spark, bounds: DataFrame, n_min: str, n_max: str, t_ref: str,
                    points: int = 100, exponent: float = 2.0) -> DataFrame:
    """``points`` evenly spaced sizes between the bounds with the reference time each.

    ``bounds`` is a one-row frame; its values enter as scalar subqueries.
    """
    one = bounds.select(F.struct(n_min, n_max, t_ref)).scalar()
    lo, hi, t0 = one[n_min], one[n_max], one[t_ref]
    frac = F.col("k") / F.lit(float(points - 1))
    grid = spark.range(points).withColumnRenamed("id", "k").withColumn("n", lo + (hi - lo) * frac)
    return grid.withColumn("t_pred", t0 * F.pow(F.col("n") / lo, F.lit(exponent)))


def union_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """Row union of tables with different columns; a missing column is NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
