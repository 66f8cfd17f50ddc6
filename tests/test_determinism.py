"""Same rows under different shuffle layouts (what a retry or another cluster sees)."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

QUERIES = ["injected_events", "injected_readings", "generated_records", "observatory_nightly",
           "nightly_conditions", "quality_report", "rule_duplicate_key", "weighted_scorecard"]


def _rows(spark, name):
    return sorted(map(repr, (tuple(r) for r in E.queries()[name](spark, SF).collect())))


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_for_any_partitioning(spark, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    results = []
    try:
        for parts, aqe in (("3", "true"), ("13", "false")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            results.append(_rows(spark, name))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert results[0] == results[1]
