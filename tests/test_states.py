"""Summaries from stored batch states against the summary over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from lakestone.operators import states as ST
from lakestone.operators.summarize import Measure, summarize
from lakestone.plans import medallion as M

SCHEMA = "k string, day date, v double, n long, name string, part string"
SPEC = (["k", ("d", "date_trunc('MONTH', day)")],
        [Measure("rows", "count"), Measure("seen", "count_nonnull", "v"), Measure("mean", "avg", "v", 3),
         Measure("dev", "stddev", "v", 3), Measure("low", "min", "v", 2), Measure("high", "max", "n"), Measure("total", "sum", "v", 1),
         Measure("days", "count_distinct", "day"), Measure("ids", "count_distinct", "n"), Measure("names", "count_distinct", "name")],
        [("mean", "desc")])


def rows(seed=3, n=400):
    import datetime as dt
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        day = dt.date(2024, rng.randrange(1, 4), rng.randrange(1, 28)) if rng.random() > 0.05 else None
        out.append((rng.choice(["a", "b", None]), day, rng.choice([None, 1e9 + rng.random(), rng.gauss(5, 2)]),
                    rng.choice([None, -70_000, -1, 0, 1, 32_768, 32_769, rng.randrange(200_000)]),
                    rng.choice([None, "", "x", "y", "ü"]), rng.choice("pqr")))
    # A group whose measure is null in one batch, and one of a single row.
    return out + [("c", None, None, None, None, "p"), ("c", None, 4.0, 7, "z", "q"), ("one", None, 2.0, 3, None, "r")]


def as_set(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def test_merged_states_equal_the_whole(spark, table, scratch):
    folder = scratch("states")
    for part in "pqr":
        ST.add_batches(table.where(F.col("part") == part), SPEC, folder, F.lit(part))
    assert as_set(ST.from_batches(spark, SPEC, folder)) == as_set(summarize(table, *SPEC))


def test_all_batches_at_once_and_one_again(spark, table, scratch):
    folder = scratch("states")
    ST.add_batches(table, SPEC, folder, F.col("part"))
    whole = as_set(summarize(table, *SPEC))
    assert as_set(ST.from_batches(spark, SPEC, folder)) == whole
    ST.add_batches(table.where("part = 'q'"), SPEC, folder, F.lit("q"))
    assert as_set(ST.from_batches(spark, SPEC, folder)) == whole
    # A corrected batch replaces what it had.
    fixed = table.where("part != 'q' OR n > 0")
    ST.add_batches(fixed.where("part = 'q'"), SPEC, folder, F.lit("q"))
    assert as_set(ST.from_batches(spark, SPEC, folder)) == as_set(summarize(fixed, *SPEC))


def test_shuffle_layout_does_not_matter(spark, table, scratch):
    folder = scratch("states")
    ST.add_batches(table.repartition(7), SPEC, folder, F.col("part"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(as_set(ST.from_batches(spark, SPEC, folder)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_no_row_is_tripled_for_two_distinct_counts(spark, table, scratch):
    folder = scratch("states")
    ST.add_batches(table, SPEC, folder, F.col("part"))
    plans = [ST.value_state(table, SPEC[0], SPEC[1]), ST.distinct_state(table, SPEC[0], SPEC[1]), ST.from_batches(spark, SPEC, folder)]
    assert all("Expand" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert "Expand" in summarize(table, *SPEC)._jdf.queryExecution().executedPlan().toString()


def test_bitmaps_hold_bounded_numbers_of_values(spark, table):
    bits = ST.distinct_state(table, SPEC[0], SPEC[1]).where("__bits IS NOT NULL")
    assert bits.agg(F.max(F.length("__bits"))).first()[0] == 4096
    assert bits.groupBy("k", "d", "__m", "__bucket").count().where("count > 1").count() == 0


def test_spec_without_distinct_counts_and_an_empty_batch(spark, table, scratch):
    spec = (["k"], SPEC[1][:7], [])
    folder = scratch("states")
    ST.add_batches(table.where("part = 'none'"), spec, folder, F.lit("empty"))
    ST.add_batches(table, spec, folder, F.col("part"))
    assert as_set(ST.from_batches(spark, spec, folder)) == as_set(summarize(table, *spec))


def test_refreshed_gold_table(spark, table, scratch):
    base = scratch("zones")
    gold = M.GoldSpec("resumen", "lecturas", SPEC, "?")
    for part in "pq":
        record = M.refresh_gold(spark, gold, base, table.where(F.col("part") == part), F.lit(part))
    want = summarize(table.where("part IN ('p', 'q')"), *SPEC)
    assert as_set(spark.read.parquet(f"{base}/gold/resumen.parquet")) == as_set(want)
    assert record["filas"] == want.count() and record["destino"].endswith("gold/resumen.parquet")
