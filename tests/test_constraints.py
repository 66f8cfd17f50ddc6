"""Compiled field constraints on rows that break each of them."""

from lakestone.operators import constraints as X


def counts(df, declared):
    return {(r.campo, r.restriccion): r.violaciones for r in X.violations(df, declared).collect()}


def test_each_kind(spark):
    rows = [("A-1", "2024-01-01T00:00:00", "1.5", 1, "x"), ("A-1", "2030-01-01 10:00:00", "-2", 2, "y"),
            ("B1", "no time", "many", 3, "z"), (None, None, None, None, None), ("A-22", "2026-12-31T23:59:59", "0", 9, "x")]
    df = spark.createDataFrame(rows, "code string, at string, size string, id int, kind string")
    got = counts(df, {
        "code": [X.typed("string"), X.required(), X.matches(r"[A-Z]-\d+"), X.unique()],
        "at": [X.typed("datetime"), X.before("2027-01-01")],
        "size": [X.typed("float64"), X.between(0.0, 1.0, above=True)],
        "id": [X.typed("int32"), X.between(2), X.required()],
        "kind": [X.one_of(["x", "y"])]})
    assert got == {("code", "type"): 0, ("code", "required"): 1, ("code", "format"): 1, ("code", "unique"): 2, ("at", "type"): 1,
                   ("at", "past"): 1, ("size", "type"): 1, ("size", "range"): 3, ("id", "type"): 0, ("id", "range"): 1,
                   ("id", "required"): 1, ("kind", "domain"): 1}


def test_absent_field_empty_table_and_odd_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, `b c` int")
    got = counts(df, {"b c": [X.between(3)], "gone": [X.required(), X.unique(), X.one_of(["x"])]})
    assert got == {("b c", "range"): 1, ("gone", "required"): 1, ("gone", "unique"): 0, ("gone", "domain"): 0}
    assert set(counts(df.limit(0), {"a": [X.required(), X.unique(), X.typed("int32")]}).values()) == {0}


def test_two_unique_fields(spark):
    df = spark.createDataFrame([(i // 2 if i < 6 else i, i if i < 20 else 0) for i in range(30)], "a int, b int")
    assert counts(df, {"a": [X.unique()], "b": [X.unique()]}) == {("a", "unique"): 6, ("b", "unique"): 11}


def test_table_is_read_once(spark, scratch):
    path = scratch("constraints")
    spark.range(100).selectExpr("id a", "cast(id as string) b").write.parquet(path)
    plan = X.violations(spark.read.parquet(path), {"a": [X.required(), X.between(3), X.unique()], "b": [X.typed("int32"), X.matches("[0-4]+")]})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Join" not in text
