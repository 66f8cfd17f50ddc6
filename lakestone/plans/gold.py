"""Gold tables and lake queries, as grouped summaries over silver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestone.operators.summarize import summarize
from lakestone.plans import observatory as obs
from lakestone.sources.readers import table_path


def conditions_by_night(readings: DataFrame) -> DataFrame:
    """Per sensor, place and calendar date: seeing, weather averages and reading count."""
    return summarize(readings, *obs.CONDITIONS_BY_NIGHT)


def sensor_summary(readings: DataFrame) -> DataFrame:
    return summarize(readings, *obs.SENSOR_SUMMARY)


def observations_by_instrument(events: DataFrame) -> DataFrame:
    return summarize(events, *obs.OBSERVATIONS_BY_INSTRUMENT)


def lake_seeing_by_sensor(spark: SparkSession, lake_uri: str, table: str = "lecturas_limpias") -> DataFrame:
    return summarize(spark.read.parquet(table_path(lake_uri, table)), *obs.LAKE_SEEING_BY_SENSOR)


def lake_by_instrument(spark: SparkSession, lake_uri: str, table: str = "eventos_limpios") -> DataFrame:
    return summarize(spark.read.parquet(table_path(lake_uri, table)), *obs.LAKE_BY_INSTRUMENT)


def table_totals(spark: SparkSession, lake_uri: str, tables: list[str],
                 total_label: str = "total") -> DataFrame:
    """Rows per table plus a total row.

    One tagged count per table, unioned, then a ``rollup`` adds the total from the same
    counts (the tables are scanned once; the union is one row per table).
    """
    counts = None
    for t in tables:
        c = (spark.read.parquet(table_path(lake_uri, t)).agg(F.count(F.lit(1)).cast("long").alias("filas"))
             .select(F.lit(t).alias("tabla"), "filas"))
        counts = c if counts is None else counts.unionByName(c)
    rolled = counts.rollup("tabla").agg(F.sum("filas").cast("long").alias("filas"))
    return rolled.select(F.coalesce(F.col("tabla"), F.lit(total_label)).alias("tabla"), "filas")


def top_row(df: DataFrame, order_col: str, ascending: bool = True, keys: list[str] | None = None) -> DataFrame:
    """The first row of a ranking (TakeOrderedAndProject: one row per task, then one).

    Ties are broken by ``keys`` so the answer is deterministic.
    """
    first = F.col(order_col).asc_nulls_last() if ascending else F.col(order_col).desc_nulls_last()
    return df.orderBy(first, *[F.col(k).asc_nulls_last() for k in (keys or [])]).limit(1)
