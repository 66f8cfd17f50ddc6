"""The flagship query: raw events -> rules -> silver -> nightly gold summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestone.functions.text import iso_seconds
from lakestone.operators import rules as R
from lakestone.operators.summarize import Measure, summarize
from lakestone.plans.medallion import silver_table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select(
        "event_id", iso_seconds("ts").alias("ts"), "user_id", "event_type", "value")
    rules = {
        "type_unknown": R.not_in("event_type", ["view", "click", "purchase", "signup"]),
        "value_outside": R.outside("value", 1.0, 300.0),
        "event_repeated": R.duplicated("event_id"),
    }
    silver = silver_table(bronze, rules, {"ts": "timestamp_ntz"})
    return summarize(silver, ["event_type", F.to_date("ts").alias("fecha")],
                     [Measure("avg_value", "avg", "value", 3),
                      Measure("min_value", "min", "value", 3),
                      Measure("n_events", "count")],
                     [("avg_value", "asc")])
