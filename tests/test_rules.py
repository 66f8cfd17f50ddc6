from pyspark.sql import functions as F

from lakestone.operators import rules as R


SCHEMA = "sensor_id string, ts string, v double"


def flags(spark, rows, method="aggregate"):
    df = spark.createDataFrame(rows, SCHEMA)
    rules = {"sensor_null": R.is_null("sensor_id"), "v_high": R.above("v", 100.0),
             "repeated": R.duplicated("sensor_id", "ts", method=method)}
    return R.apply_rules(df, rules), list(rules)


def test_null_measure_alone_drops_but_is_not_invalid(spark):
    flagged, names = flags(spark, [("S1", "t1", None), ("S2", "t2", 5.0)])
    rows = {r.sensor_id: r for r in flagged.collect()}
    assert rows["S1"].v_high is None and rows["S1"].tiene_error is None
    assert rows["S2"].tiene_error is False
    kept = R.keep_valid(flagged)
    assert [r.sensor_id for r in kept.collect()] == ["S2"]
    counts = R.rule_counts(flagged, names).first()
    assert counts.filas_invalidas == 0 and counts.total_filas == 2 and counts.filas_conservadas == 1


def test_null_measure_with_violation_is_true(spark):
    flagged, _ = flags(spark, [(None, "t1", None)])
    r = flagged.first()
    assert r.sensor_null is True and r.v_high is None and r.tiene_error is True


def test_null_keys_are_equal_for_duplicates(spark):
    for method in ("aggregate", "digest"):
        flagged, _ = flags(spark, [(None, "t1", 1.0), (None, "t1", 2.0), ("S1", "t1", 1.0)], method)
        got = sorted((r.v, r.sensor_id or "", r.repeated) for r in flagged.collect())
        assert got == [(1.0, "", True), (1.0, "S1", False), (2.0, "", True)]


def test_every_copy_is_flagged(spark):
    rows = [("S1", "t1", 1.0)] * 3 + [("S2", "t1", 1.0)]
    flagged, _ = flags(spark, rows)
    assert flagged.filter("repeated").count() == 3
    assert R.keep_valid(flagged).count() == 1


def test_not_in_keeps_null_unknown(spark):
    df = spark.createDataFrame([("CCD",), ("RADAR",), (None,)], "i string")
    got = [r.f for r in df.select(R.not_in("i", ["CCD"]).alias("f")).collect()]
    assert got == [False, True, None]


def test_any_is_kleene_not_greatest(spark):
    df = spark.createDataFrame([(None, False), (None, True), (False, False)], "a boolean, b boolean")
    got = [r.x for r in df.select(R.any_flag(["a", "b"]).alias("x")).collect()]
    assert got == [None, True, False]


def test_report_long_form_and_empty_input(spark):
    flagged, names = flags(spark, [("S1", "t1", 150.0), (None, "t2", 1.0), ("S3", "t3", 1.0), ("S4", "t4", 1.0)])
    rep = {r.regla: r for r in R.quality_report(flagged, names).collect()}
    assert rep["v_high"].total_invalidos == 1 and rep["v_high"].porcentaje == 25.0
    assert rep[R.SUMMARY_RULE].total_invalidos == 2 and rep[R.SUMMARY_RULE].porcentaje == 50.0
    empty, names = flags(spark, [])
    rep = {r.regla: r for r in R.quality_report(empty, names).collect()}
    assert rep[R.SUMMARY_RULE].porcentaje == 0.0 and rep[R.SUMMARY_RULE].total_filas == 0
    s = R.report_summary(R.rule_counts(empty, names)).first()
    assert s.tasa_error_pct == 0.0 and s.filas_validas == 0


def test_hot_key_keeps_every_row(spark):
    # One key holds a third of the rows; all of its rows are flagged, none is lost.
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    out = R.flag_duplicates(df, ["k"], "dup")
    assert out.count() == 3000
    assert out.filter("dup").count() == 1000
    same = R.flag_duplicates(df, ["k"], "dup", method="digest")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, same.collect()))


def test_digest_method_equals_grouping_by_text(spark):
    rows = [(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, None), (5, None), (6, "delta"),
            (7, "delta"), (8, "delta"), (9, "alph")]
    df = spark.createDataFrame(rows, "id long, text string")
    a = {r.id: r.dup for r in R.flag_duplicates(df, ["text"], "dup", method="digest").collect()}
    b = {r.id: r.dup for r in R.flag_duplicates(df, ["text"], "dup").collect()}
    assert a == b == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: True, 9: False}


def test_grouped_counts_equal_flag_counts(spark):
    rows = [("S1", "t1", 150.0), ("S1", "t1", 1.0), (None, "t2", None), (None, "t2", 5.0), ("S3", "t3", None),
            ("S4", "t4", 1.0), ("S5", "t5", 101.0), (None, "t6", 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    rules = {"sensor_null": R.is_null("sensor_id"), "v_high": R.above("v", 100.0),
             "repeated": R.duplicated("sensor_id", "ts")}
    a = R.rule_counts(R.apply_rules(df, rules), list(rules)).first().asDict()
    b = R.rule_counts_grouped(df, rules).first().asDict()
    assert a == b
    assert a["filas_invalidas"] == 6 and a["filas_conservadas"] == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert R.rule_counts_grouped(empty, rules).first().total_filas == 0


def test_strict_casts_fail_on_bad_text(spark):
    import pytest
    from lakestone.plans.medallion import cast_columns
    good = spark.createDataFrame([("2024-03-01T00:05:00", "1.5", "7")], "t string, x string, d string")
    row = cast_columns(good, {"t": "timestamp_ntz", "x": "double", "d": "int"}).first()
    assert str(row.t) == "2024-03-01 00:05:00" and row.x == 1.5 and row.d == 7
    bad = spark.createDataFrame([("abc",)], "x string")
    with pytest.raises(Exception):
        cast_columns(bad, {"x": "double"}).collect()
    bad_ts = spark.createDataFrame([("2024-03-01 00:05",)], "t string")
    with pytest.raises(Exception):
        cast_columns(bad_ts, {"t": "timestamp_ntz"}).collect()


def _nodes(plan):
    """A physical plan's nodes, those of adaptive stages and reused exchanges included."""
    yield plan
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _rows_shuffled(df, column):
    """Rows written by the exchanges that carry ``column``."""
    found = 0
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "ShuffleExchangeExec" and f"{column}#" in node.output().toString():
            found += node.metrics().apply("shuffleRecordsWritten").value()
    return found


def _rows_of_two_keys(spark):
    """3,000 rows of which keys a and b repeat in ten and in six rows."""
    rows = [(i, i if i >= 10 else i // 5, f"k{i}" if i < 2994 else "same", "x" * 50) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, a long, b string, payload string"), rows


def test_rows_that_occur_once_are_not_shuffled(spark):
    df, rows = _rows_of_two_keys(spark)
    rules = {"a_repeated": R.duplicated("a"), "b_repeated": R.duplicated("b", method="digest")}
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for some in (rules, {"a_repeated": rules["a_repeated"]}, {"b_repeated": rules["b_repeated"]}):
            flagged = R.apply_rules(df, some)
            got = {r.id: tuple(r[n] for n in some) for r in flagged.collect()}
            want = {"a_repeated": lambda i: i < 10, "b_repeated": lambda i: i >= 2994}
            assert got == {i: tuple(want[n](i) for n in some) for i, *_ in rows}
            assert 0 < _rows_shuffled(flagged, "payload") <= 16 * len(some)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_two_duplicate_rules_share_one_exchange_of_keys(spark):
    df, _ = _rows_of_two_keys(spark)
    rules = {"a_repeated": R.duplicated("a"), "b_repeated": R.duplicated("b"), "long": R.above("a", 2990)}
    plan = R.repeated_hashes(df, {n: rules[n] for n in ("a_repeated", "b_repeated")})._jdf.queryExecution().executedPlan()
    kinds = [n.getClass().getSimpleName() for n in _nodes(plan)]
    assert kinds.count("ShuffleExchangeExec") == 2  # all keys, then the repeated ones
    counts = R.rule_counts_grouped(df, rules).first()
    assert (counts.total_filas, counts.a_repeated, counts.b_repeated, counts.filas_invalidas) == (3000, 10, 6, 19)


def test_full_filter_still_compares_keys(spark):
    """A filter of few bits marks every row: flags come from the keys alone, also for a hot and a null key."""
    rows = [(i, None if i % 3 == 0 else i // 2, f"t{i % 40}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a long, b string")
    rules = {"x": R.duplicated("a"), "y": R.duplicated("a", "b"), "z": R.duplicated("b", method="digest")}
    keys = {"x": lambda r: r[1], "y": lambda r: r[1:], "z": lambda r: r[2]}
    from collections import Counter
    seen = {n: Counter(map(k, rows)) for n, k in keys.items()}
    for bits in (1, 64, 1 << 12):
        got = {r.id: (r.x, r.y, r.z) for r in R.flag_all_duplicates(df, rules, bits).collect()}
        assert got == {r[0]: tuple(seen[n][k(r)] > 1 for n, k in keys.items()) for r in rows}
