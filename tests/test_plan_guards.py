"""Plan-shape guards for every registered query (regression checks for scale)."""

import contextlib
import io
import os

import pytest

import __spark_entry__ as E
from lakestone.plans.driver_queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "FlatMapGroupsInPandas"]


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_python_rows(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"


@pytest.mark.parametrize("name", ["rule_sentinel", "rule_range", "flagged_rows", "heavy_transform",
                                  "nightly_conditions", "quality_report"])
def test_scans_read_only_needed_columns(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert schemas
    for line in schemas:
        fields = line.split("struct<", 1)[1].count(":")
        assert fields <= 6, line   # the widest table read here has 11 columns


def test_silver_filters_reach_the_scan(spark):
    plan = _plan(E.queries()["silver_lineitem"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan or "LessThanOrEqual(l_quantity,45.0)" in plan


def _without_broadcast(spark, name) -> str:
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = E.queries()[name](spark, SF)
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_duplicate_texts_are_not_shuffled(spark):
    plan = _without_broadcast(spark, "rule_duplicate_key")
    lines = plan.splitlines()
    assert any("Exchange hashpartitioning(__dg" in line for line in lines)
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line and "ReusedExchange" not in line:
            below = next(x for x in lines[i + 1:] if "Project" in x or "HashAggregate" in x)
            assert "text#" not in below.split("sha2", 1)[0].split("Project", 1)[-1], below


@pytest.mark.parametrize("name", ["injected_events", "injected_readings", "shuffled_readings"])
def test_no_single_task_window(spark, name):
    assert "SinglePartition" not in _without_broadcast(spark, name)


@pytest.mark.parametrize("name", ["scenario_stats", "baseline_relative", "quadratic_reference", "scenario_cv_ratio",
                                  "weighted_scorecard"])
def test_fact_table_is_scanned_once(spark, name):
    plan = _without_broadcast(spark, name)
    scans = [x for x in plan.splitlines() if "FileScan" in x and "s_name" not in x]
    assert len(scans) == 1, plan
