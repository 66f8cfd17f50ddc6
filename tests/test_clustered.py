"""Clustered Parquet: row groups that a filter on either column has to read, from the files' own statistics."""

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakestone.session import local_path
from lakestone.sources.clustered import position, write_clustered


def readings(spark, sensors=64, each=250):
    start = dt.datetime(2024, 3, 1)
    df = spark.range(sensors * each).select(
        F.format_string("SENS-%03d", F.col("id") % sensors).alias("sensor_id"),
        (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor(F.col("id") / sensors) * 5)).alias("timestamp"),
        (F.col("id") * 7 % 1000 / 10).alias("value"))
    return df, start


def groups(path):
    """(statistics of each row group) of all files."""
    out = []
    for name in glob.glob(f"{local_path(path)}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            out.append({k: (s.min, s.max) for k, s in cols.items() if s and s.has_min_max})
    return out


def read(found, column, low, high):
    return sum(g[column][0] <= high and g[column][1] >= low for g in found) / len(found)


def test_both_filters_skip_row_groups(spark, scratch):
    df, start = readings(spark)
    clustered, sorted_ = scratch("clustered"), scratch("sorted")
    write_clustered(df, clustered, ["sensor_id", "timestamp"], files=64)
    df.repartitionByRange(64, "sensor_id", "timestamp").sortWithinPartitions("sensor_id", "timestamp").write.parquet(sorted_)
    hour = (start + dt.timedelta(hours=6), start + dt.timedelta(hours=7))
    found, plain = groups(clustered), groups(sorted_)
    assert len(found) >= 60 and len(plain) >= 60
    by_sensor, by_time = read(found, "sensor_id", "SENS-017", "SENS-017"), read(found, "timestamp", *hour)
    assert by_sensor <= 0.3 and by_time <= 0.3
    assert read(plain, "timestamp", *hour) > 0.9  # a plain sort helps one filter only
    back = spark.read.parquet(clustered)
    assert back.dtypes == df.dtypes and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_spark_skips_them_too(spark, scratch):
    df, start = readings(spark)
    path = scratch("clustered")
    write_clustered(df, path, ["sensor_id", "timestamp"], files=32)
    hit = spark.read.parquet(path).where(F.col("sensor_id") == "SENS-017")
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(sensor_id), EqualTo(sensor_id,SENS-017)]" in plan and hit.count() == 250


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("a", dt.date(2024, 1, 1), 1)] * 50 + [("b", None, None), (None, dt.date(2025, 1, 1), -5)]])
def test_nulls_ties_and_no_rows(spark, scratch, rows):
    df = spark.createDataFrame(rows, "name string, day date, n int")
    path = write_clustered(df, scratch("clustered"), ["name", "day", "n"], files=3)
    assert sorted(map(repr, spark.read.parquet(path).collect())) == sorted(map(repr, df.collect()))


def test_neighbours_in_one_column_differ_little_in_place(spark):
    df = spark.range(4096).select((F.col("id") % 64).alias("a"), F.floor(F.col("id") / 64).alias("b"))
    placed = df.withColumn("p", position(df, ["a", "b"], bits=6))
    assert placed.select("p").distinct().count() > 3900
    quarter = placed.where("a < 31 and b < 31").agg(F.max("p")).first()[0]
    assert quarter < 1024 and placed.agg(F.max("p")).first()[0] <= 4095


def test_other_types_are_refused(spark):
    df = spark.createDataFrame([([1],)], "a array<int>")
    with pytest.raises(TypeError, match="array"):
        position(df, ["a"])
