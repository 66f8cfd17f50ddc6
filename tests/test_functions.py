import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lakestone.functions import draws
from lakestone.functions.numeric import mebibytes, pairs, percent, round_half_away
from lakestone.functions.text import clean_null_tokens, file_stem


VALUES = [1.005, 2.675, -1.005, 0.125, -0.125, 1234.5678, 2.5, -2.5, 0.0, 1e-9, 99.995]


@pytest.mark.parametrize("scale", [0, 1, 2, 3])
def test_round_matches_sql_engine(spark, scale):
    df = spark.createDataFrame([(v,) for v in VALUES], "x double")
    got = [r.y for r in df.select(round_half_away("x", scale).alias("y")).collect()]
    con = duckdb.connect()
    want = [con.execute(f"SELECT ROUND(CAST(? AS DOUBLE), {scale})", [v]).fetchone()[0] for v in VALUES]
    assert got == want


def test_round_differs_from_spark_native_on_ties(spark):
    row = spark.range(1).select(round_half_away(F.lit(1.005), 2).alias("a"), F.round(F.lit(1.005), 2).alias("b")).first()
    assert row.a == 1.0 and row.b == 1.01


def test_percent_zero_guard(spark):
    df = spark.createDataFrame([(5, 0), (1, 3), (0, 10)], "n long, t long")
    got = [r.p for r in df.select(percent("n", "t").alias("p")).collect()]
    assert got == [0.0, 33.33, 0.0]


def test_pairs_and_sizes(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (1500,), (3_000_000_000,)], "n long")
    got = [r.p for r in df.select(pairs("n").alias("p")).collect()]
    assert got == [0, 0, 1, 1500 * 1499 // 2, 3_000_000_000 * 2_999_999_999 // 2]
    mb = spark.range(1).select(mebibytes(F.lit(131072)).alias("m")).first().m
    assert mb == 1.0


def test_null_tokens_and_stem(spark):
    df = spark.createDataFrame([("",), ("NULL",), ("null",), ("NA",), ("x",), (None,)], "s string")
    got = [r.c for r in df.select(clean_null_tokens("s").alias("c")).collect()]
    assert got == [None, None, None, None, "x", None]
    p = spark.createDataFrame([("/a/b/lecturas_limpias.parquet",), ("s3a://b/x/y.json",), ("c",)], "p string")
    assert [r.s for r in p.select(file_stem("p").alias("s")).collect()] == ["lecturas_limpias", "y", "c"]


def test_draws_do_not_depend_on_partitioning(spark):
    base = spark.range(2000)
    cols = [draws.uniform01("id", "a").alias("u"), draws.normal("id", "b", 5.0, 2.0).alias("z"),
            draws.randint("id", "c", 1, 6).alias("k"), draws.choice("id", "d", ["x", "y", "z"]).alias("ch"),
            draws.weighted_choice("id", "e", ["p", "q", "r"], [0.7, 0.2, 0.1]).alias("w")]
    a = sorted(tuple(r) for r in base.repartition(7).select("id", *cols).collect())
    b = sorted(tuple(r) for r in base.coalesce(1).select("id", *cols).collect())
    assert a == b
    us = [r[1] for r in a]
    assert 0.0 < min(us) and max(us) < 1.0
    ks = {r[3] for r in a}
    assert ks == {1, 2, 3, 4, 5, 6}
    ws = [r[5] for r in a]
    assert 0.6 < ws.count("p") / len(ws) < 0.8


def test_cluster_conf_sizes_partitions():
    from lakestone.session import cluster_conf
    conf = cluster_conf(100 * (1 << 40), total_cores=8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert cluster_conf(1 << 20, total_cores=8)["spark.sql.shuffle.partitions"] == "16"


def test_means_are_plain(spark):
    """Means neither cut small digits nor fail on large or special values."""
    from lakestone.operators.summarize import Measure, summarize
    def mean(values):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        return summarize(df, [], [Measure("m", "avg", "x")]).first().m
    assert mean([1e-8, 3e-8]) == 2e-8
    assert mean([1e13, 3e13]) == 2e13
    assert mean([0.1234567, 0.1234568]) == (0.1234567 + 0.1234568) / 2
    assert mean([123456789.012345, 0.000000000000001]) == (123456789.012345 + 1e-15) / 2
    assert mean([float("inf"), 1.0]) == float("inf")
    assert str(mean([float("nan"), 1.0])) == "nan"
    assert mean([None, None]) is None and mean([None, 2.0]) == 2.0


def test_transform_code_stays_compilable(spark):
    """The JVM interprets methods beyond 8,000 bytes of bytecode: the transform must stay below."""
    import re
    from lakestone.operators.transform import heavy_transform
    df = heavy_transform(spark.range(10).selectExpr("id AS user_id", "'A' AS category", "id * 1.5D AS value", "'t' AS text"))
    found = df._jdf.queryExecution().debug().codegenToSeq()
    sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]
    assert sizes and max(sizes) < 8000, sizes


def test_slices_of_one_digest(spark):
    """A salt's slices are other draws of the same digest; a salt without one is slice 0."""
    import hashlib
    df = spark.range(2000).select(
        "id", *[draws.uniform01("id", f"s@{k}").alias(f"u{k}") for k in range(8)], draws.uniform01("id", "s").alias("u"),
        *[draws.hash_score("id", f"s@{k}").alias(f"h{k}") for k in range(4)], draws.std_normal("id", "s@6").alias("z"))
    rows = df.collect()
    for r in rows[:50]:
        digest = hashlib.sha256(f"{r.id}:s".encode()).hexdigest()
        assert r.u == r.u0 and [r[f"u{k}"] for k in range(8)] == [(int(digest[8 * k:8 * k + 8], 16) + 0.5) / 2**32 for k in range(8)]
        assert [r[f"h{k}"] for k in range(4)] == [int(digest[16 * k:16 * k + 15], 16) for k in range(4)]
        assert abs(r.z - math.sqrt(-2 * math.log(r.u6)) * math.cos(2 * math.pi * r.u7)) < 1e-9
    columns = [[r[f"u{k}"] - 0.5 for r in rows] for k in range(8)]
    for i in range(8):
        for j in range(i):
            assert abs(sum(a * b for a, b in zip(columns[i], columns[j])) / len(rows) * 12) < 0.1
