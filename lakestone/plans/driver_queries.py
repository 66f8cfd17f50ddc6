"""Queries over the shared test tables, one per operator of the package.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame built with the package's
operators.  Column names match the SQL in ``lakestone.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lakestone import sources as io
from lakestone.functions.numeric import mebibytes, pairs, per_unit, round_half_away
from lakestone.functions.text import iso_seconds
from lakestone.operators import rules as R
from lakestone.operators import stats as S
from lakestone.operators.sampling import SCORE_LIMIT, rank_in_sample
from lakestone.operators.summarize import Measure, summarize
from lakestone.plans import catalog as C
from lakestone.plans import generate as G
from lakestone.plans import gold
from lakestone.plans import medallion as M
from lakestone.session import scratch_path


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- gold analogues
NIGHTLY_LIKE = (
    ["event_type", ("fecha", "to_date(ts)")],
    [Measure("avg_value", "avg", "value", 3), Measure("min_value", "min", "value", 3), Measure("n_events", "count")],
    [("avg_value", "asc")])


def nightly_conditions(spark, sf_dir):
    return summarize(_t(spark, sf_dir, "events"), *NIGHTLY_LIKE)


SENSOR_LIKE = [
    Measure("n_rows", "count"),
    Measure("avg_discount", "avg", "l_discount", 3),
    Measure("std_discount", "stddev", "l_discount", 3),
    Measure("min_quantity", "min", "l_quantity", 3),
    Measure("avg_tax", "avg", "l_tax", 3),
    Measure("min_price", "min", "l_extendedprice", 2),
    Measure("max_price", "max", "l_extendedprice", 2),
    Measure("avg_quantity", "avg", "l_quantity", 2),
]


def sensor_summary(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return summarize(li, ["l_returnflag", "l_linestatus"], SENSOR_LIKE, [("avg_discount", "asc")])


INSTRUMENT_LIKE = (
    ["o_orderstatus", "o_orderpriority"],
    [Measure("n_orders", "count"),
     Measure("avg_price", "avg", "o_totalprice", 1),
     Measure("min_price", "min", "o_totalprice", 1),
     Measure("max_price", "max", "o_totalprice", 1),
     Measure("avg_year", "avg", "order_year", 2),
     Measure("n_customers", "count_distinct", "o_custkey"),
     Measure("n_days", "count_distinct", "order_day")],
    [("o_orderstatus", "asc"), ("n_orders", "desc")])


def _dated_orders(spark, sf_dir):
    return (_t(spark, sf_dir, "orders").withColumn("order_year", F.year("o_orderdate"))
            .withColumn("order_day", F.to_date("o_orderdate")))


def observations_by_instrument(spark, sf_dir):
    return summarize(_dated_orders(spark, sf_dir), *INSTRUMENT_LIKE)


def _from_batches(spark, df, spec, batch, again):
    """All batches stored at once, one of them delivered a second time; the summary comes from the states."""
    base = scratch_path(spark, "gold_batches")
    gold_spec = M.GoldSpec("resumen", "", spec)
    for rows in (df, df.where(batch == again)):
        M.refresh_gold(spark, gold_spec, base, rows, batch)
    return spark.read.parquet(f"{base}/gold/resumen.parquet")


def nightly_from_batches(spark, sf_dir):
    return _from_batches(spark, _t(spark, sf_dir, "events"), NIGHTLY_LIKE, F.date_format("ts", "yyyy-MM-dd"), "2024-01-02")


def sensors_from_batches(spark, sf_dir):
    return _from_batches(spark, _t(spark, sf_dir, "lineitem"), (["l_returnflag", "l_linestatus"], SENSOR_LIKE, [("avg_discount", "asc")]),
                         F.date_format("l_shipdate", "yyyy"), "1995")


def instruments_from_batches(spark, sf_dir):
    return _from_batches(spark, _dated_orders(spark, sf_dir), INSTRUMENT_LIKE, F.date_format("o_orderdate", "yyyy"), "1995")


def lake_query_sensor(spark, sf_dir):
    # The lake base URI is a parameter: a local folder here, s3a://bucket/prefix on a cluster.
    li = io.read_table(spark, sf_dir, "lineitem")
    return summarize(li, ["l_returnflag", "l_linestatus"],
                     [Measure("avg_discount", "avg", "l_discount", 3),
                      Measure("min_price", "min", "l_extendedprice", 3),
                      Measure("n_rows", "count")],
                     [("avg_discount", "asc")])


def lake_query_instrument(spark, sf_dir):
    o = io.read_table(spark, sf_dir, "orders")
    return summarize(o, ["o_orderstatus", "o_orderpriority"],
                     [Measure("n_orders", "count"), Measure("avg_price", "avg", "o_totalprice", 1)],
                     [("o_orderstatus", "asc"), ("n_orders", "desc")])


def lake_totals(spark, sf_dir):
    return gold.table_totals(spark, sf_dir, ["events", "orders"])


# -------------------------------------------------------------------- rules (Q1-Q13, F*)
LINEITEM_IDS = ["l_orderkey", "l_linenumber", "l_suppkey"]


def _rule_query(df: DataFrame, ids: list[str], name: str, rule) -> DataFrame:
    flagged = R.apply_rules(df, {name: rule}, any_name="__any")
    return flagged.select(*ids, name)


def rule_sentinel(spark, sf_dir):
    return _rule_query(_t(spark, sf_dir, "lineitem"), LINEITEM_IDS, "discount_sentinel",
                       R.equals("l_discount", 0.0))


def rule_upper_bound(spark, sf_dir):
    return _rule_query(_t(spark, sf_dir, "lineitem"), LINEITEM_IDS, "quantity_above",
                       R.above("l_quantity", 45.0))


def rule_lower_bound(spark, sf_dir):
    return _rule_query(_t(spark, sf_dir, "lineitem"), LINEITEM_IDS, "price_below",
                       R.below("l_extendedprice", 1000.0))


def rule_null(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select(
        "event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_kind"))
    return _rule_query(ev, ["event_id"], "kind_null", R.is_null("event_kind"))


def rule_domain(spark, sf_dir):
    return _rule_query(_t(spark, sf_dir, "events"), ["event_id"], "type_unknown",
                       R.not_in("event_type", ["view", "click", "purchase"]))


def rule_range(spark, sf_dir):
    return _rule_query(_t(spark, sf_dir, "events"), ["event_id"], "value_outside",
                       R.outside("value", 1.0, 300.0))


def rule_prefix(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("event_id", iso_seconds("ts").alias("ts_text"))
    return _rule_query(ev, ["event_id"], "late_month", R.starts_with("ts_text", "2024-01-3"))


def rule_duplicate_key(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    # Digests of the whole texts are compared; no text is shuffled.
    return _rule_query(docs, ["doc_id"], "text_repeated", R.duplicated("text", method="digest"))


def rule_duplicate_composite(spark, sf_dir):
    return _rule_query(_t(spark, sf_dir, "lineitem"), LINEITEM_IDS, "line_repeated",
                       R.duplicated("l_orderkey", "l_linenumber"))


def lineitem_rules() -> dict:
    return {
        "discount_sentinel": R.equals("l_discount", 0.0),
        "quantity_above": R.above("l_quantity", 45.0),
        "price_below": R.below("l_extendedprice", 1000.0),
        "line_repeated": R.duplicated("l_orderkey", "l_linenumber"),
    }


def flagged_rows(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(*LINEITEM_IDS, "l_discount", "l_quantity", "l_extendedprice")
    rules = lineitem_rules()
    return R.apply_rules(li, rules).select(*LINEITEM_IDS, *rules, R.ANY_ERROR)


def quality_report(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount",
                                               "l_quantity", "l_extendedprice")
    rules = lineitem_rules()
    # Counts only: one aggregate by the duplicate key, no per-row join back.
    return R.report_from_counts(R.rule_counts_grouped(li, rules), list(rules))


def quality_report_two_keys(spark, sf_dir):
    """A report with two duplicate rules: their keys share one exchange, and only repeated keys are compared."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    rules = {"discount_sentinel": R.equals("l_discount", 0.0), "line_repeated": R.duplicated("l_orderkey", "l_linenumber"),
             "purchase_repeated": R.duplicated("l_partkey", "l_suppkey", "l_quantity")}
    return R.report_from_counts(R.rule_counts_grouped(li, rules), list(rules))


# ------------------------------------------------------------------- silver (M2, M3, P*)
LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def silver_lineitem(spark, sf_dir):
    bronze = _t(spark, sf_dir, "lineitem").select(*LINEITEM_COLS, iso_seconds("l_shipdate").alias("l_shipdate"))
    rules = {
        "quantity_above": R.above("l_quantity", 45.0),
        "price_below": R.below("l_extendedprice", 1000.0),
        "line_repeated": R.duplicated("l_orderkey", "l_linenumber"),
        "ship_future": R.starts_with("l_shipdate", "2001"),
    }
    casts = {"l_shipdate": "timestamp_ntz", "l_quantity": "double", "l_linenumber": "int"}
    return M.silver_table(bronze, rules, casts)


def silver_events(spark, sf_dir):
    bronze = _t(spark, sf_dir, "events").select(
        "event_id", iso_seconds("ts").alias("ts"), "user_id", "event_type", "value", "props")
    rules = {
        "type_unknown": R.not_in("event_type", ["view", "click", "purchase", "signup"]),
        "value_outside": R.outside("value", 1.0, 300.0),
        "late_month": R.starts_with("ts", "2024-01-3"),
        "event_repeated": R.duplicated("event_id"),
    }
    casts = {"ts": "timestamp_ntz", "value": "double", "user_id": "int"}
    return M.silver_table(bronze, rules, casts)


def null_flag_semantics(spark, sf_dir):
    """NULLs derived from the data: signup rows lose the user key, error rows the measure."""
    ev = _t(spark, sf_dir, "events").select(
        "event_id",
        # Hour as text: a zone-free key (date_trunc would turn the naive time into an instant).
        F.date_format("ts", "yyyy-MM-dd HH").alias("ts_hour"),
        F.when(F.col("event_type") != "signup", F.col("user_id")).alias("user_key"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("measure"))
    rules = {
        "key_null": R.is_null("user_key"),
        "measure_high": R.above("measure", 300.0),
        "key_repeated": R.duplicated("user_key", "ts_hour"),
    }
    flagged = R.apply_rules(ev, rules)
    return flagged.select("event_id", *rules, R.ANY_ERROR,
                          F.coalesce(~F.col(R.ANY_ERROR), F.lit(False)).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "nightly_conditions": nightly_conditions,
    "sensor_summary": sensor_summary,
    "observations_by_instrument": observations_by_instrument,
    "nightly_from_batches": nightly_from_batches,
    "sensors_from_batches": sensors_from_batches,
    "instruments_from_batches": instruments_from_batches,
    "lake_query_sensor": lake_query_sensor,
    "lake_query_instrument": lake_query_instrument,
    "lake_totals": lake_totals,
    "rule_sentinel": rule_sentinel,
    "rule_upper_bound": rule_upper_bound,
    "rule_lower_bound": rule_lower_bound,
    "rule_null": rule_null,
    "rule_domain": rule_domain,
    "rule_range": rule_range,
    "rule_prefix": rule_prefix,
    "rule_duplicate_key": rule_duplicate_key,
    "rule_duplicate_composite": rule_duplicate_composite,
    "flagged_rows": flagged_rows,
    "quality_report": quality_report,
    "quality_report_two_keys": quality_report_two_keys,
    "silver_lineitem": silver_lineitem,
    "silver_events": silver_events,
    "null_flag_semantics": null_flag_semantics,
}


# ------------------------------------------------------------ statistics


def scenario_stats(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    st = S.group_stats(ev, ["event_type"], "value", order="event_id", prefix="value", scale=6,
                       rows_name="n_events")
    return S.with_bounds(st, "value_mean", "series").orderBy("event_type")


def scenario_names(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_type").distinct()


def top_answers(spark, sf_dir):
    best = gold.top_row(sensor_summary(spark, sf_dir), "avg_discount", True, ["l_returnflag", "l_linestatus"])
    best = best.select(F.lit("lowest_mean_discount").alias("question"),
                       F.concat_ws("/", "l_returnflag", "l_linestatus").alias("answer"),
                       F.col("avg_discount").cast("double").alias("value"))
    done = (_t(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
            .groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")))
    most = gold.top_row(done, "n", False, ["o_orderpriority"]).select(
        F.lit("most_finished_orders").alias("question"), F.col("o_orderpriority").alias("answer"),
        F.col("n").cast("double").alias("value"))
    return best.unionByName(most)


def scenario_cv_ratio(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").withColumn("size_bucket", (F.col("user_id") % 10).cast("long"))
    means = ev.groupBy("size_bucket").agg(
        *[S.conditional_mean("value", F.col("event_type") == k).alias(k) for k in ("view", "purchase")],
        S.coefficient_of_variation("value").alias("cv"))
    return means.withColumn("ratio", F.col("view") / F.col("purchase")).select(
        "size_bucket",
        round_half_away("view", 4).alias("avg_view"),
        round_half_away("purchase", 4).alias("avg_purchase"),
        round_half_away("ratio", 4).alias("ratio"),
        round_half_away("cv", 4).alias("cv"))


def conditional_mean_ratio(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    purchase = S.conditional_mean("value", F.col("event_type") == "purchase")
    view = S.conditional_mean("value", F.col("event_type") == "view")
    return ev.agg(round_half_away(purchase, 6).alias("avg_purchase"),
                  round_half_away(view, 6).alias("avg_view"),
                  round_half_away(purchase / view, 6).alias("ratio"))


def scenario_union(spark, sf_dir):
    ev = (_t(spark, sf_dir, "events").groupBy("event_type")
          .agg(F.count(F.lit(1)).cast("double").alias("tamano_n"),
               round_half_away(F.avg("value"), 4).alias("tiempo_s"))
          .select(F.concat(F.lit("events_"), "event_type").alias("escenario"), "tamano_n", "tiempo_s"))
    li = (_t(spark, sf_dir, "lineitem").groupBy("l_returnflag")
          .agg(round_half_away(mebibytes(F.sum("l_quantity")), 6).alias("tamano_mb"),
               round_half_away(F.avg("l_extendedprice"), 4).alias("throughput_mb_s"))
          .select(F.concat(F.lit("lineitem_"), "l_returnflag").alias("escenario"), "tamano_mb", "throughput_mb_s"))
    o = (_t(spark, sf_dir, "orders").groupBy("o_orderstatus")
         .agg(pairs(F.count(F.lit(1))).cast("double").alias("tamano_pares"),
              F.count_distinct("o_custkey").cast("int").alias("repeticion"))
         .select(F.concat(F.lit("orders_"), "o_orderstatus").alias("escenario"), "tamano_pares", "repeticion"))
    return S.union_tables([ev, li, o])


def throughput_measures(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    n = F.col("l_quantity").cast("long")
    return li.select("l_orderkey", "l_linenumber",
                     pairs(n).alias("n_pairs"),
                     round_half_away(per_unit("l_extendedprice", "l_quantity"), 4).alias("unit_price"),
                     round_half_away(mebibytes(n * 1000), 6).alias("size_mb"),
                     F.abs(F.col("l_discount") - F.lit(0.05)).alias("discount_gap"))


def baseline_relative(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    monthly = (li.groupBy(F.trunc(F.to_date("l_shipdate"), "month").alias("month"))
               .agg(F.sum("l_extendedprice").alias("time_s")))
    ref = S.scalars(monthly, month=F.min("month"), time=F.min_by("time_s", "month"))
    with_p = monthly.withColumn("p", F.months_between("month", ref["month"]).cast("int") + 1)
    table = S.scaling_table(with_p, "p", "time_s", ref["time"])
    return table.select("month", "p",
                        round_half_away("time_s", 2).alias("time_s"),
                        round_half_away("speedup", 6).alias("speedup"),
                        round_half_away("efficiency", 6).alias("efficiency"),
                        round_half_away("overhead_s", 2).alias("overhead_s"),
                        round_half_away("useful_time_s", 2).alias("useful_time_s"))


def quadratic_reference(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    per_n = li.groupBy(F.col("l_quantity").alias("n")).agg(F.avg("l_extendedprice").alias("t_mean"))
    curve = S.quadratic_reference(per_n, "n", "t_mean")
    return curve.select("n", round_half_away("t_mean", 4).alias("t_mean"),
                        round_half_away("t_pred", 4).alias("t_pred"),
                        round_half_away(F.col("t_mean") / F.col("t_pred"), 6).alias("ratio"))


def quadratic_curve(spark, sf_dir):
    """100 evenly spaced sizes between the smallest and largest quantity, each with the
    quadratic reference time from the smallest size's mean price."""
    li = _t(spark, sf_dir, "lineitem")
    per_n = li.groupBy(F.col("l_quantity").alias("n")).agg(F.avg("l_extendedprice").alias("t_mean"))
    bounds = per_n.agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"),
                       F.min_by("t_mean", "n").alias("t_ref"))
    curve = S.reference_curve(spark, bounds, "n_min", "n_max", "t_ref")
    return curve.select("k", round_half_away("n", 6).alias("n"), round_half_away("t_pred", 4).alias("t_pred"))


# -------------------------------------------------------------- transform
def heavy_transform(spark, sf_dir):
    from lakestone.operators.partitioning import spread
    from lakestone.operators.transform import heavy_transform as ht
    ev = spread(_t(spark, sf_dir, "events"))
    out = ht(ev, user="user_id", category="event_type", value="value", text="props")
    return out.withColumn("score", round_half_away("score", 6))


# ------------------------------------------------------------ ranking
# Fixed parameters of the supplier scorecard (criteria and their weights, summing to 1).
SCORECARD_WEIGHTS = {"revenue": 0.4, "n_lines": 0.3, "avg_quantity": 0.2, "low_discount": 0.1}


def weighted_scorecard(spark, sf_dir):
    from lakestone.operators import ranking as K
    li = _t(spark, sf_dir, "lineitem")
    metrics = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.avg("l_quantity").alias("avg_quantity"),
        (F.lit(1.0) - F.avg("l_discount")).alias("low_discount"))
    crit = list(SCORECARD_WEIGHTS)
    top = S.scalars(metrics, **{c: F.max(c) for c in crit})
    scores = metrics.select("s_suppkey", *[(F.col(c) / top[c]).alias(c) for c in crit])
    labels = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    ranked = K.weighted_ranking(scores, "s_suppkey", SCORECARD_WEIGHTS, labels)
    return ranked.select("s_suppkey", "s_name", round_half_away("score_total", 6).alias("score_total"))


QUERIES.update({
    "scenario_stats": scenario_stats,
    "scenario_names": scenario_names,
    "top_answers": top_answers,
    "scenario_cv_ratio": scenario_cv_ratio,
    "conditional_mean_ratio": conditional_mean_ratio,
    "scenario_union": scenario_union,
    "throughput_measures": throughput_measures,
    "baseline_relative": baseline_relative,
    "quadratic_reference": quadratic_reference,
    "quadratic_curve": quadratic_curve,
    "heavy_transform": heavy_transform,
    "weighted_scorecard": weighted_scorecard,
})


# ------------------------------------------------ sources and sinks

CUSTOMER_SCHEMA = StructType([
    StructField("c_custkey", LongType()), StructField("c_name", StringType()),
    StructField("c_nationkey", IntegerType()), StructField("c_acctbal", DoubleType()),
    StructField("c_mktsegment", StringType()),
])

# Raw-text tokens written for three market segments (each must read back as NULL).
SEGMENT_TOKENS = {"HOUSEHOLD": "NA", "MACHINERY": "null", "BUILDING": "", "FURNITURE": "NULL"}
# Text with leading and trailing blanks, quotes, a comma and a last backslash.
NAME_BEFORE, NAME_AFTER = '  "', '", said \\ '


def bronze_csv_roundtrip(spark, sf_dir):
    cu = _t(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    token = seg
    for value, tok in SEGMENT_TOKENS.items():
        token = F.when(F.col("c_mktsegment") == value, F.lit(tok)).otherwise(token)
    name = F.concat(F.lit(NAME_BEFORE), "c_name", F.lit(NAME_AFTER)).alias("c_name")
    raw = cu.select(F.col("c_custkey").cast("string"), name,
                    *[F.col(c).cast("string") for c in ["c_nationkey", "c_acctbal"]],
                    token.alias("c_mktsegment"))
    path = io.write_csv(raw, scratch_path(spark, "customer_csv"))
    return io.read_csv_tokens(spark, path, CUSTOMER_SCHEMA)


DOCUMENT_SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType()),
    StructField("n_chars", LongType())])


def bronze_quoted_csv(spark, sf_dir):
    """Whole texts with quotes, separators and line breaks through CSV; a file is read by as many tasks as it has blocks."""
    raw = _t(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    path = io.write_csv(raw, scratch_path(spark, "documents_csv"))
    return io.read_csv_tokens(spark, path, DOCUMENT_SCHEMA, multi_line=True)


EVENTS_SCHEMA = StructType([
    StructField("event_id", LongType()), StructField("ts", StringType()), StructField("user_id", LongType()),
    StructField("event_type", StringType()), StructField("value", DoubleType()), StructField("props", StringType()),
])


def bronze_ndjson_roundtrip(spark, sf_dir):
    ev = _t(spark, sf_dir, "events").select("event_id", iso_seconds("ts").alias("ts"), "user_id",
                                           "event_type", "value", "props")
    path = io.write_ndjson(ev, scratch_path(spark, "events_ndjson"))
    return io.read_ndjson(spark, path, EVENTS_SCHEMA)


def parquet_roundtrip(spark, sf_dir):
    path = io.write_parquet(_t(spark, sf_dir, "lineitem"), scratch_path(spark, "lineitem_parquet"))
    return io.read_parquet(spark, path)


def parquet_clustered(spark, sf_dir):
    """Orders written so that filters on customer and on date both skip row groups, and read back."""
    path = io.write_clustered(_t(spark, sf_dir, "orders"), scratch_path(spark, "orders_clustered"), ["o_custkey", "o_orderdate"])
    return spark.read.parquet(path)


def lake_upload(spark, sf_dir):
    lake = scratch_path(spark, "lake")
    uploaded = io.upload_tables(spark, io.discover(spark, sf_dir, "*.parquet"), lake)
    names = [u.rsplit("/", 1)[-1][:-len(".parquet")] for u in uploaded]
    return gold.table_totals(spark, lake, names)


def object_inventory(spark, sf_dir):
    return io.inventory(spark, sf_dir, "*.parquet").select("object_name", "size_bytes", "size_kb")


# --------------------------------------------------- pipeline, catalog, lineage (M1-M8)

def events_sources(sf_dir: str) -> list:
    rules = {
        "type_unknown": R.not_in("event_type", ["view", "click", "purchase", "signup"]),
        "value_outside": R.outside("value", 1.0, 300.0),
        "late_month": R.starts_with("ts", "2024-01-3"),
        "event_repeated": R.duplicated("event_id"),
    }
    return [M.SourceSpec(
        name="events.parquet", path=f"{sf_dir.rstrip('/')}/events.parquet", fmt="parquet", schema=None,
        bronze="events_raw", silver="events_clean", rules=rules, casts={"ts": "timestamp_ntz"},
        prepare=lambda df: df.select("event_id", iso_seconds("ts").alias("ts"), "user_id",
                                     "event_type", "value", "props"))]


def events_golds() -> list:
    by_day = (["event_type", F.to_date("ts").alias("fecha")],
              [Measure("avg_value", "avg", "value", 3), Measure("n_events", "count")],
              [("avg_value", "asc")])
    by_type = (["event_type"],
               [Measure("n_events", "count"), Measure("n_users", "count_distinct", "user_id")],
               [("n_events", "desc")])
    return [M.GoldSpec("events_by_day", "events_clean", by_day, "which days had the highest values"),
            M.GoldSpec("events_by_type", "events_clean", by_type, "which event types are most common")]


def events_run(spark, sf_dir, with_gold=True):
    return M.run(spark, events_sources(sf_dir), events_golds() if with_gold else [], scratch_path(spark, "medallion"))


def medallion_summary(spark, sf_dir):
    return M.run_summary(spark, events_run(spark, sf_dir))


def lineage_table(spark, sf_dir):
    return C.lineage_rows(spark, events_run(spark, sf_dir))


def quality_document(spark, sf_dir):
    runinfo = events_run(spark, sf_dir, with_gold=False)
    path = io.write_json_document(C.quality_document(spark, runinfo), scratch_path(spark, "quality_doc"))
    doc = io.read_variant_document(spark, path)
    sources = io.members(doc, F.variant_get("doc", "$.fuentes", "variant"), "fuente", "__source")
    rules = io.members(sources, F.variant_get("__source", "$.por_regla", "variant"), "regla", "__rule")
    return rules.where(F.col("regla") != R.SUMMARY_RULE).select(
        "fuente", F.variant_get("__source", "$.filas_validas", "long").alias("filas_validas"), "regla",
        F.variant_get("__rule", "$.total_invalidos", "long").alias("total_invalidos"),
        F.variant_get("__rule", "$.porcentaje", "double").alias("porcentaje"))


EVENTS_CATALOG = {
    "events": C.Table("User events.", [
        C.Field("event_id", "bigint", True, "Not null. Unique."),
        C.Field("ts", "timestamp", True, "Not null."),
        C.Field("user_id", "bigint", True, "Not null."),
        C.Field("event_type", "string", True, "Values: view, click, purchase, signup, error."),
        C.Field("value", "double", False, "Range 1-300."),
        C.Field("props", "string", False, "JSON text.", descripcion="Event properties."),
        C.Field("session_id", "string", False, "Declared but not delivered."),
    ]),
}


def field_catalog(spark, sf_dir):
    fields = C.field_table(C.catalog_frame(spark, EVENTS_CATALOG))
    ev = _t(spark, sf_dir, "events").withColumn(
        "value", F.when(F.col("event_type") != "error", F.col("value")))
    checked = C.check_catalog(fields, ev, "events")
    return checked.select("nombre", "tipo", "obligatorio", "regla", "descripcion", "filas", "nulos", "cumple")


def evidence_summary(spark, sf_dir):
    """Eight findings as text rows, from the tables and the run's own documents.

    Every source is a one-row aggregate; they are cross-joined (one row each) and the
    eight findings are unpivoted with ``inline``, so each source is computed once.
    """
    from lakestone.functions.numeric import round_half_away as rh
    runinfo = events_run(spark, sf_dir)
    two = lambda c: F.format_string("%.2f", rh(c, 2))
    means = _t(spark, sf_dir, "events").agg(
        two(S.conditional_mean("value", F.col("event_type") == "click")).alias("click_mean"),
        two(S.conditional_mean("value", F.col("event_type") == "purchase")
            / S.conditional_mean("value", F.col("event_type") == "view")).alias("ratio"))
    qpath = io.write_json_document(C.quality_document(spark, runinfo), scratch_path(spark, "evidence_quality"))
    lpath = io.write_json_document(C.lineage_document(spark, runinfo, "events_pipeline"), scratch_path(spark, "evidence_lineage"))
    quality = io.read_variant_document(spark, qpath).select(
        F.variant_get("doc", "$.fuentes.events_clean.filas_validas", "long").alias("valid"),
        F.variant_get("doc", "$.fuentes.events_clean.filas_entrada", "long").alias("rows_in"),
        F.variant_get("doc", "$.fuentes.events_clean.tasa_error_pct", "double").alias("rate"))
    lineage = io.read_variant_document(spark, lpath).select(
        F.size(F.variant_get("doc", "$.etapas.gold", "array<variant>")).alias("n_gold"))
    lake = gold.table_totals(spark, sf_dir, ["events", "orders"]).agg(
        F.max(F.when(F.col("tabla") == "total", F.col("filas"))).alias("lake_rows"),
        F.count_if(F.col("tabla") != "total").alias("datasets"))
    one = means.select("*", *[frame.select(c).scalar().alias(c) for frame in (quality, lineage, lake)
                              for c in frame.columns])
    row = lambda src, what, val, unit: F.struct(F.lit(src).alias("fuente"), F.lit(what).alias("hallazgo"),
                                               val.cast("string").alias("valor"), F.lit(unit).alias("unidad"))
    return one.select(F.inline(F.array(
        row("events", "mean click value", F.col("click_mean"), "value"),
        row("events", "purchase/view mean ratio", F.col("ratio"), "x"),
        row("pipeline", "valid rows in silver", F.col("valid"), "rows"),
        row("pipeline", "rows in bronze", F.col("rows_in"), "rows"),
        row("pipeline", "error rate", F.format_string("%.2f%%", F.col("rate")), "percent"),
        row("pipeline", "gold tables", F.col("n_gold"), "tables"),
        row("lake", "rows in lake", F.col("lake_rows"), "rows"),
        row("lake", "parquet datasets", F.col("datasets"), "files"))))


QUERIES.update({
    "bronze_csv_roundtrip": bronze_csv_roundtrip,
    "bronze_quoted_csv": bronze_quoted_csv,
    "bronze_ndjson_roundtrip": bronze_ndjson_roundtrip,
    "parquet_roundtrip": parquet_roundtrip,
    "parquet_clustered": parquet_clustered,
    "lake_upload": lake_upload,
    "object_inventory": object_inventory,
    "medallion_summary": medallion_summary,
    "lineage_table": lineage_table,
    "quality_document": quality_document,
    "field_catalog": field_catalog,
    "evidence_summary": evidence_summary,
})


# --------------------------------------------- generation and injection


def _event_index(spark, sf_dir):
    """The events ids (0..n-1) serve as the generator's row index.

    Generation is CPU work (several SHA-256 draws per row), so the id column is spread
    over the cluster's cores when the table scans as fewer tasks.
    """
    from lakestone.operators.partitioning import spread
    idx = _t(spark, sf_dir, "events").select(F.col("event_id").alias("i"))
    n, low, high = idx.agg(F.count("i"), F.min("i"), F.max("i")).first()
    if n and (low, high) != (0, n - 1):
        raise ValueError(f"event ids must be 0..{n - 1} without gaps, found {low}..{high}")
    return spread(idx), n


def generated_readings(spark, sf_dir):
    idx, n = _event_index(spark, sf_dir)
    return G.readings_from_index(idx, n // 5, own_digests=True)


def generated_events(spark, sf_dir):
    idx, _ = _event_index(spark, sf_dir)
    return G.events_from_index(idx)


def generated_records(spark, sf_dir):
    idx, _ = _event_index(spark, sf_dir)
    return G.records_from_index(idx).withColumn("value", round_half_away("value", 6))


def _injected_readings(spark, sf_dir, own_digests=False):
    idx, n = _event_index(spark, sf_dir)
    nps = n // 5
    base = G.readings_from_index(idx, nps, own_digests=own_digests)
    return G.inject_reading_errors(base, G.error_count(nps * 5, 0.10, 8), own_digests=own_digests)


def injected_readings(spark, sf_dir):
    return _injected_readings(spark, sf_dir, own_digests=True).select(*G.READING_COLUMNS)


def injected_events(spark, sf_dir):
    idx, n = _event_index(spark, sf_dir)
    out = G.inject_event_errors(G.events_from_index(idx), n, G.error_count(n, 0.10, 5))
    return out.select(*G.EVENT_COLUMNS)


def injection_counts(spark, sf_dir):
    return G.injected_counts(_injected_readings(spark, sf_dir, own_digests=True))


def observatory_run(spark, sf_dir, kinds=("readings", "events"), tables=None):
    """The source system's own pipeline on generated raw files, as far as it is asked for.

    Readings and observation events (one of each per events row, over the whole table)
    with injected errors are written as CSV and NDJSON, ingested to bronze, refined to
    silver with the exact rule registries, and summarized into the gold ``tables``
    (default: all of the given kinds).  Returns the stage records and the zones' folder.
    """
    from lakestone.plans import observatory as obs
    idx, n = _event_index(spark, sf_dir)
    nps = n // 5
    raw = scratch_path(spark, "observatory_raw")

    def readings():
        out = G.inject_reading_errors(G.readings_from_index(idx, nps), G.error_count(nps * 5, 0.10, 8))
        return io.write_csv(out.select(*G.READING_COLUMNS), f"{raw}/{obs.RAW_READINGS}")

    def events():
        out = G.inject_event_errors(G.events_from_index(idx), n, G.error_count(n, 0.10, 5))
        return io.write_ndjson(out.select(*G.EVENT_COLUMNS), f"{raw}/{obs.RAW_EVENTS}")

    paths = dict(zip(kinds, M.side_by_side([{"readings": readings, "events": events}[k] for k in kinds]), strict=True))
    golds = [g for g in obs.golds(kinds) if tables is None or g.name in tables]
    base = scratch_path(spark, "observatory_zones")
    return M.run(spark, obs.sources(paths), golds, base), base


def observatory_quality(spark, sf_dir):
    """Per-rule quality report of both silver tables (the 13 rules)."""
    runinfo, _ = observatory_run(spark, sf_dir, tables=())
    rows = []
    for s_ in runinfo.silver:
        stem = s_["destino"].rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for rule, v in s_["reporte_calidad"].items():
            count = v.get("total_invalidos", v.get("filas_invalidas"))
            pct = v.get("porcentaje", v.get("tasa_error_pct"))
            rows.append((stem, rule, int(count), float(pct), int(s_["filas_entrada"]), int(s_["filas_validas"])))
    return spark.createDataFrame(rows, "fuente string, regla string, total_invalidos long, porcentaje double, "
                                       "filas_entrada long, filas_validas long")


def _observatory_gold(spark, sf_dir, kind, table):
    _, base = observatory_run(spark, sf_dir, (kind,), (table,))
    return spark.read.parquet(f"{base}/gold/{table}.parquet")


def observatory_nightly(spark, sf_dir):
    return _observatory_gold(spark, sf_dir, "readings", "condiciones_por_noche")


def observatory_sensors(spark, sf_dir):
    return _observatory_gold(spark, sf_dir, "readings", "resumen_sensores")


def observatory_instruments(spark, sf_dir):
    return _observatory_gold(spark, sf_dir, "events", "observaciones_por_instrumento")


def _observatory_lake(spark, sf_dir, kind, silver):
    """A lake that holds the silver table of one source, uploaded from the pipeline's zones."""
    _, base = observatory_run(spark, sf_dir, (kind,), ())
    lake = scratch_path(spark, "observatory_lake")
    io.upload_tables(spark, [f"{base}/silver/{silver}.parquet"], lake)
    return lake


def observatory_lake_sensors(spark, sf_dir):
    """The lake query by sensor, with its own columns, over the uploaded silver readings."""
    return gold.lake_seeing_by_sensor(spark, _observatory_lake(spark, sf_dir, "readings", "lecturas_limpias"))


def observatory_lake_instruments(spark, sf_dir):
    """The lake query by instrument and state, with its own columns, over the uploaded silver events."""
    return gold.lake_by_instrument(spark, _observatory_lake(spark, sf_dir, "events", "eventos_limpios"))


def _catalog_readings(spark, sf_dir):
    """The readings that the catalog's queries check: with sliced draws, as their SQL has them."""
    return _injected_readings(spark, sf_dir).select(*G.READING_COLUMNS)


def shipped_catalog(spark, sf_dir):
    """The 19 declared fields of the two sources, checked against readings and events
    generated (with errors) from the events table."""
    base = C.field_table(C.catalog_frame(spark, C.SHIPPED))
    checked = [C.check_catalog(base, injected(spark, sf_dir), table)
               for table, injected in (("lecturas_sensores", _catalog_readings), ("eventos_observacion", injected_events))]
    return checked[0].unionByName(checked[1]).select("tabla", "nombre", "tipo", "obligatorio", "filas", "nulos", "cumple",
                                                     (F.length("descripcion") > 0).alias("descrito"))


def catalog_violations(spark, sf_dir):
    """Rows that break each constraint of the 19 declared fields, in generated data with errors."""
    found = [C.violations(injected(spark, sf_dir), table, C.SHIPPED[table])
             for table, injected in (("lecturas_sensores", _catalog_readings), ("eventos_observacion", injected_events))]
    return found[0].unionByName(found[1])


def shuffled_readings(spark, sf_dir):
    """The readings in the reproducible order in which they are written to a file, with their place in it."""
    from lakestone.functions.draws import hash_score
    idx, n = _event_index(spark, sf_dir)
    base = G.readings_from_index(idx, n // 5).withColumn("__s", hash_score("i", "42:mix"))
    place = rank_in_sample(base, "__s", "i", (SCORE_LIMIT, (1 << 63) - 1), n, "place")
    return base.join(place, "i").select("i", "place", "sensor_id", "timestamp")


MEASUREMENT_SCHEMA = StructType([
    StructField("escenario", StringType()), StructField("repeticion", LongType()), StructField("tiempo_s", DoubleType())])


def measurement_csv(spark, sf_dir):
    """Measurements written as CSV, read with an explicit schema, and grouped: times of up to 17 digits."""
    li = _t(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("escenario"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("repeticion"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") / F.lit(7.0e9)).alias("tiempo_s"))
    back = io.read_csv_tokens(spark, io.write_csv(li, scratch_path(spark, "measurements_csv")), MEASUREMENT_SCHEMA)
    return S.group_stats(back, ["escenario"], "tiempo_s", order="repeticion", rows_name="filas")


def object_sizes(spark, sf_dir):
    """The object inventory in a form that SQL can check: every table's file is there and its KB are bytes / 1024."""
    inv = io.inventory(spark, sf_dir, "*.parquet")
    return inv.select("object_name", (F.col("size_bytes") > 0).alias("has_size"),
                      (F.col("size_kb") * 1024 == F.col("size_bytes")).alias("kb_is_bytes_over_1024"))


QUERIES.update({
    "observatory_quality": observatory_quality,
    "observatory_nightly": observatory_nightly,
    "observatory_sensors": observatory_sensors,
    "observatory_instruments": observatory_instruments,
    "observatory_lake_sensors": observatory_lake_sensors,
    "observatory_lake_instruments": observatory_lake_instruments,
    "generated_readings": generated_readings,
    "generated_events": generated_events,
    "generated_records": generated_records,
    "injected_readings": injected_readings,
    "injected_events": injected_events,
    "injection_counts": injection_counts,
    "shipped_catalog": shipped_catalog,
    "catalog_violations": catalog_violations,
    "shuffled_readings": shuffled_readings,
    "measurement_csv": measurement_csv,
    "object_sizes": object_sizes,
})
