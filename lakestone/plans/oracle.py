"""Independent SQL for each driver query (DuckDB dialect, tables as views).

The SQL is written from the query's meaning, not generated from the Spark plan, so a
match is evidence both are right.  ROUND on doubles scales, rounds half away from zero
and unscales; the Spark side does the same through ``round_half_away``.
"""

from __future__ import annotations

ISO = "'%Y-%m-%dT%H:%M:%S'"

LINEITEM_COLS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                 "l_discount, l_tax, l_returnflag, l_linestatus")

ORACLE: dict[str, str] = {}

ORACLE["nightly_conditions"] = """
SELECT event_type, CAST(ts AS DATE) AS fecha,
       ROUND(AVG(value), 3) AS avg_value, ROUND(MIN(value), 3) AS min_value,
       COUNT(*) AS n_events
FROM events GROUP BY event_type, CAST(ts AS DATE)
ORDER BY avg_value, event_type, fecha
"""

ORACLE["sensor_summary"] = """
SELECT l_returnflag, l_linestatus, COUNT(*) AS n_rows,
       ROUND(AVG(l_discount), 3) AS avg_discount, ROUND(STDDEV_SAMP(l_discount), 3) AS std_discount,
       ROUND(MIN(l_quantity), 3) AS min_quantity, ROUND(AVG(l_tax), 3) AS avg_tax,
       ROUND(MIN(l_extendedprice), 2) AS min_price, ROUND(MAX(l_extendedprice), 2) AS max_price,
       ROUND(AVG(l_quantity), 2) AS avg_quantity
FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY avg_discount
"""

ORACLE["observations_by_instrument"] = """
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n_orders,
       ROUND(AVG(o_totalprice), 1) AS avg_price, ROUND(MIN(o_totalprice), 1) AS min_price,
       ROUND(MAX(o_totalprice), 1) AS max_price, ROUND(AVG(year(o_orderdate)), 2) AS avg_year,
       COUNT(DISTINCT o_custkey) AS n_customers, COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS n_days
FROM orders GROUP BY o_orderstatus, o_orderpriority ORDER BY o_orderstatus, n_orders DESC
"""

# Summaries from stored states of batches are those over all rows.
for _name, _whole in (("nightly_from_batches", "nightly_conditions"), ("sensors_from_batches", "sensor_summary"),
                      ("instruments_from_batches", "observations_by_instrument")):
    ORACLE[_name] = ORACLE[_whole]

ORACLE["lake_query_sensor"] = """
SELECT l_returnflag, l_linestatus, ROUND(AVG(l_discount), 3) AS avg_discount,
       ROUND(MIN(l_extendedprice), 3) AS min_price, COUNT(*) AS n_rows
FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY avg_discount
"""

ORACLE["lake_query_instrument"] = """
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n_orders, ROUND(AVG(o_totalprice), 1) AS avg_price
FROM orders GROUP BY o_orderstatus, o_orderpriority ORDER BY o_orderstatus, n_orders DESC
"""

ORACLE["lake_totals"] = """
SELECT 'events' AS tabla, (SELECT COUNT(*) FROM events) AS filas
UNION ALL SELECT 'orders', (SELECT COUNT(*) FROM orders)
UNION ALL SELECT 'total', (SELECT COUNT(*) FROM events) + (SELECT COUNT(*) FROM orders)
"""

ORACLE["rule_sentinel"] = """
SELECT l_orderkey, l_linenumber, l_suppkey, l_discount = 0.0 AS discount_sentinel FROM lineitem
"""

ORACLE["rule_upper_bound"] = """
SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity > 45.0 AS quantity_above FROM lineitem
"""

ORACLE["rule_lower_bound"] = """
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice < 1000.0 AS price_below FROM lineitem
"""

ORACLE["rule_null"] = """
SELECT event_id, NULLIF(event_type, 'error') IS NULL AS kind_null FROM events
"""

ORACLE["rule_domain"] = """
SELECT event_id, event_type NOT IN ('view', 'click', 'purchase') AS type_unknown FROM events
"""

ORACLE["rule_range"] = """
SELECT event_id, (value < 1.0 OR value > 300.0) AS value_outside FROM events
"""

ORACLE["rule_prefix"] = f"""
SELECT event_id, starts_with(strftime(ts, {ISO}), '2024-01-3') AS late_month FROM events
"""

ORACLE["rule_duplicate_key"] = """
SELECT doc_id, COUNT(*) OVER (PARTITION BY text) > 1 AS text_repeated FROM documents
"""

ORACLE["rule_duplicate_composite"] = """
SELECT l_orderkey, l_linenumber, l_suppkey,
       COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS line_repeated
FROM lineitem
"""

_LINEITEM_FLAGS = """
SELECT l_orderkey, l_linenumber, l_suppkey,
       l_discount = 0.0 AS discount_sentinel,
       l_quantity > 45.0 AS quantity_above,
       l_extendedprice < 1000.0 AS price_below,
       COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS line_repeated
FROM lineitem
"""

ORACLE["flagged_rows"] = f"""
SELECT *, (discount_sentinel OR quantity_above OR price_below OR line_repeated) AS tiene_error
FROM ({_LINEITEM_FLAGS}) f
"""

ORACLE["quality_report"] = f"""
WITH f AS (
  SELECT *, (discount_sentinel OR quantity_above OR price_below OR line_repeated) AS tiene_error
  FROM ({_LINEITEM_FLAGS}) x
), c AS (
  SELECT COUNT(*) AS total_filas,
         COUNT(*) FILTER (WHERE discount_sentinel) AS discount_sentinel,
         COUNT(*) FILTER (WHERE quantity_above) AS quantity_above,
         COUNT(*) FILTER (WHERE price_below) AS price_below,
         COUNT(*) FILTER (WHERE line_repeated) AS line_repeated,
         COUNT(*) FILTER (WHERE tiene_error) AS filas_invalidas
  FROM f
), l AS (
  SELECT 'discount_sentinel' AS regla, discount_sentinel AS total_invalidos, total_filas FROM c
  UNION ALL SELECT 'quantity_above', quantity_above, total_filas FROM c
  UNION ALL SELECT 'price_below', price_below, total_filas FROM c
  UNION ALL SELECT 'line_repeated', line_repeated, total_filas FROM c
  UNION ALL SELECT '__resumen__', filas_invalidas, total_filas FROM c
)
SELECT regla, total_invalidos,
       CASE WHEN total_filas > 0 THEN ROUND(total_invalidos / total_filas * 100.0, 2) ELSE 0.0 END AS porcentaje,
       total_filas
FROM l
"""

ORACLE["quality_report_two_keys"] = """
WITH f AS (
  SELECT l_discount = 0.0 AS a, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS b,
         COUNT(*) OVER (PARTITION BY l_partkey, l_suppkey, l_quantity) > 1 AS c FROM lineitem
), n AS (
  SELECT COUNT(*) AS total_filas, COUNT(*) FILTER (WHERE a) AS a, COUNT(*) FILTER (WHERE b) AS b,
         COUNT(*) FILTER (WHERE c) AS c, COUNT(*) FILTER (WHERE a OR b OR c) AS d FROM f
), l AS (
  SELECT 'discount_sentinel' AS regla, a AS total_invalidos, total_filas FROM n
  UNION ALL SELECT 'line_repeated', b, total_filas FROM n
  UNION ALL SELECT 'purchase_repeated', c, total_filas FROM n
  UNION ALL SELECT '__resumen__', d, total_filas FROM n
)
SELECT regla, total_invalidos,
       CASE WHEN total_filas > 0 THEN ROUND(total_invalidos / total_filas * 100.0, 2) ELSE 0.0 END AS porcentaje,
       total_filas
FROM l
"""

ORACLE["silver_lineitem"] = f"""
WITH b AS (
  SELECT {LINEITEM_COLS}, strftime(l_shipdate, {ISO}) AS l_shipdate FROM lineitem
), f AS (
  SELECT *, l_quantity > 45.0 AS e1, l_extendedprice < 1000.0 AS e2,
         COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS e3,
         starts_with(l_shipdate, '2001') AS e4
  FROM b
)
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS INTEGER) AS l_linenumber,
       CAST(l_quantity AS DOUBLE) AS l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, CAST(strptime(l_shipdate, {ISO}) AS TIMESTAMP) AS l_shipdate
FROM f WHERE NOT (e1 OR e2 OR e3 OR e4)
"""

ORACLE["silver_events"] = f"""
WITH b AS (
  SELECT event_id, strftime(ts, {ISO}) AS ts, user_id, event_type, value, props FROM events
), f AS (
  SELECT *, event_type NOT IN ('view', 'click', 'purchase', 'signup') AS e1,
         (value < 1.0 OR value > 300.0) AS e2, starts_with(ts, '2024-01-3') AS e3,
         COUNT(*) OVER (PARTITION BY event_id) > 1 AS e4
  FROM b
)
SELECT event_id, CAST(strptime(ts, {ISO}) AS TIMESTAMP) AS ts, CAST(user_id AS INTEGER) AS user_id,
       event_type, CAST(value AS DOUBLE) AS value, props
FROM f WHERE NOT (e1 OR e2 OR e3 OR e4)
"""

ORACLE["null_flag_semantics"] = """
WITH b AS (
  SELECT event_id, date_trunc('hour', ts) AS ts_hour,
         CASE WHEN event_type <> 'signup' THEN user_id END AS user_key,
         CASE WHEN event_type <> 'error' THEN value END AS measure
  FROM events
), f AS (
  SELECT event_id, user_key IS NULL AS key_null, measure > 300.0 AS measure_high,
         COUNT(*) OVER (PARTITION BY user_key, ts_hour) > 1 AS key_repeated
  FROM b
)
SELECT event_id, key_null, measure_high, key_repeated,
       (key_null OR measure_high OR key_repeated) AS tiene_error,
       COALESCE(NOT (key_null OR measure_high OR key_repeated), false) AS kept
FROM f
"""

ORACLE["scenario_stats"] = """
WITH s AS (
  SELECT event_type, ROUND(AVG(value), 6) AS value_mean, ROUND(STDDEV_SAMP(value), 6) AS value_std,
         COUNT(value) AS value_count,
         arg_min(value, CASE WHEN value IS NOT NULL THEN event_id END) AS value_first,
         COUNT(*) AS n_events
  FROM events WHERE event_type IS NOT NULL GROUP BY event_type
)
SELECT s.*, b.series_min, b.series_max
FROM s CROSS JOIN (SELECT MIN(value_mean) AS series_min, MAX(value_mean) AS series_max FROM s) b
ORDER BY event_type
"""

ORACLE["scenario_names"] = "SELECT DISTINCT event_type FROM events"

ORACLE["top_answers"] = """
(SELECT 'lowest_mean_discount' AS question, l_returnflag || '/' || l_linestatus AS answer,
        CAST(ROUND(AVG(l_discount), 3) AS DOUBLE) AS value
 FROM lineitem GROUP BY l_returnflag, l_linestatus
 ORDER BY value, l_returnflag, l_linestatus LIMIT 1)
UNION ALL
(SELECT 'most_finished_orders', o_orderpriority, CAST(COUNT(*) AS DOUBLE)
 FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority
 ORDER BY COUNT(*) DESC, o_orderpriority LIMIT 1)
"""

ORACLE["scenario_cv_ratio"] = """
WITH e AS (SELECT *, user_id % 10 AS size_bucket FROM events),
p AS (
  SELECT size_bucket,
         AVG(CASE WHEN event_type = 'view' THEN value END) AS v,
         AVG(CASE WHEN event_type = 'purchase' THEN value END) AS pu,
         STDDEV_SAMP(value) / AVG(value) AS cv
  FROM e GROUP BY size_bucket
)
SELECT size_bucket, ROUND(v, 4) AS avg_view, ROUND(pu, 4) AS avg_purchase,
       ROUND(v / pu, 4) AS ratio, ROUND(cv, 4) AS cv
FROM p
"""

ORACLE["conditional_mean_ratio"] = """
SELECT ROUND(AVG(CASE WHEN event_type = 'purchase' THEN value END), 6) AS avg_purchase,
       ROUND(AVG(CASE WHEN event_type = 'view' THEN value END), 6) AS avg_view,
       ROUND(AVG(CASE WHEN event_type = 'purchase' THEN value END)
             / AVG(CASE WHEN event_type = 'view' THEN value END), 6) AS ratio
FROM events
"""

ORACLE["scenario_union"] = """
SELECT 'events_' || event_type AS escenario, CAST(COUNT(*) AS DOUBLE) AS tamano_n,
       ROUND(AVG(value), 4) AS tiempo_s
FROM events GROUP BY event_type
UNION ALL BY NAME
SELECT 'lineitem_' || l_returnflag AS escenario,
       ROUND(SUM(l_quantity) * 8.0 / 1048576.0, 6) AS tamano_mb,
       ROUND(AVG(l_extendedprice), 4) AS throughput_mb_s
FROM lineitem GROUP BY l_returnflag
UNION ALL BY NAME
SELECT 'orders_' || o_orderstatus AS escenario,
       CAST((COUNT(*) * (COUNT(*) - 1)) // 2 AS DOUBLE) AS tamano_pares,
       CAST(COUNT(DISTINCT o_custkey) AS INTEGER) AS repeticion
FROM orders GROUP BY o_orderstatus
"""

ORACLE["throughput_measures"] = """
SELECT l_orderkey, l_linenumber,
       (CAST(l_quantity AS BIGINT) * (CAST(l_quantity AS BIGINT) - 1)) // 2 AS n_pairs,
       ROUND(l_extendedprice / NULLIF(l_quantity, 0.0), 4) AS unit_price,
       ROUND(CAST(l_quantity AS BIGINT) * 1000 * 8.0 / 1048576.0, 6) AS size_mb,
       ABS(l_discount - 0.05) AS discount_gap
FROM lineitem
"""

ORACLE["baseline_relative"] = """
WITH m AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, SUM(l_extendedprice) AS time_s
  FROM lineitem GROUP BY 1
), f AS (SELECT MIN(month) AS first_month FROM m),
p AS (
  SELECT m.month, CAST(date_diff('month', f.first_month, m.month) + 1 AS INTEGER) AS p, m.time_s
  FROM m CROSS JOIN f
), b AS (SELECT arg_min(time_s, p) AS t1 FROM p)
SELECT month, p, ROUND(time_s, 2) AS time_s,
       ROUND(t1 / time_s, 6) AS speedup,
       ROUND(t1 / time_s / p, 6) AS efficiency,
       ROUND(time_s - t1 / p, 2) AS overhead_s,
       ROUND(time_s - (time_s - t1 / p), 2) AS useful_time_s
FROM p CROSS JOIN b
"""

ORACLE["quadratic_reference"] = """
WITH g AS (SELECT l_quantity AS n, AVG(l_extendedprice) AS t_mean FROM lineitem GROUP BY l_quantity),
b AS (SELECT MIN(n) AS n_ref, arg_min(t_mean, n) AS t_ref FROM g),
c AS (SELECT g.n, g.t_mean, b.t_ref * pow(g.n / b.n_ref, 2.0) AS t_pred FROM g CROSS JOIN b)
SELECT n, ROUND(t_mean, 4) AS t_mean, ROUND(t_pred, 4) AS t_pred, ROUND(t_mean / t_pred, 6) AS ratio FROM c
"""


ORACLE["quadratic_curve"] = """
WITH g AS (SELECT l_quantity AS n, AVG(l_extendedprice) AS t_mean FROM lineitem GROUP BY l_quantity),
b AS (SELECT MIN(n) AS n_min, MAX(n) AS n_max, arg_min(t_mean, n) AS t_ref FROM g),
c AS (SELECT r.range AS k, b.n_min + (b.n_max - b.n_min) * (r.range / 99.0) AS n, b.n_min, b.t_ref
      FROM range(100) r CROSS JOIN b)
SELECT k, ROUND(n, 6) AS n, ROUND(t_ref * pow(n / n_min, 2.0), 4) AS t_pred FROM c
"""


def _trig_sql(x: str, terms: int = 50) -> str:
    acc = "0.0"
    for i in range(terms):
        s = f"sin({x} + {i}.0)"
        c = f"cos({x} * {i}.0 + {i}.0)"
        acc = f"({acc} + ({s} * {s} + {c} * {c}))"
    return acc


ORACLE["heavy_transform"] = f"""
SELECT user_id, event_type AS category, ROUND({_trig_sql('value')}, 6) AS score,
       substr(sha256(props || CAST(user_id AS VARCHAR)), 1, 8) AS hash_prefix
FROM events
"""

ORACLE["weighted_scorecard"] = """
WITH m AS (
  SELECT l_suppkey AS s_suppkey, SUM(l_extendedprice * (1 - l_discount)) AS revenue,
         CAST(COUNT(*) AS DOUBLE) AS n_lines, AVG(l_quantity) AS avg_quantity,
         1.0 - AVG(l_discount) AS low_discount
  FROM lineitem GROUP BY l_suppkey
), x AS (
  SELECT MAX(revenue) AS mr, MAX(n_lines) AS mn, MAX(avg_quantity) AS mq, MAX(low_discount) AS md FROM m
), s AS (
  SELECT s_suppkey, revenue / mr * 0.4 + n_lines / mn * 0.3 + avg_quantity / mq * 0.2
         + low_discount / md * 0.1 AS score_total
  FROM m CROSS JOIN x
)
SELECT s.s_suppkey, p.s_name, ROUND(s.score_total, 6) AS score_total
FROM s LEFT JOIN supplier p ON p.s_suppkey = s.s_suppkey
"""

ORACLE["bronze_csv_roundtrip"] = """
SELECT c_custkey, '  "' || c_name || '", said \\ ' AS c_name, c_nationkey, c_acctbal,
       CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY', 'BUILDING', 'FURNITURE') THEN NULL ELSE c_mktsegment END
         AS c_mktsegment
FROM customer
"""

ORACLE["bronze_quoted_csv"] = """
SELECT doc_id, CASE WHEN text IN ('', 'NULL', 'null', 'NA') THEN NULL ELSE text END AS text, source, n_chars FROM documents
"""

ORACLE["bronze_ndjson_roundtrip"] = f"""
SELECT event_id, strftime(ts, {ISO}) AS ts, user_id, event_type, value, props FROM events
"""

ORACLE["parquet_roundtrip"] = "SELECT * FROM lineitem"

ORACLE["parquet_clustered"] = "SELECT * FROM orders"

_ALL_TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
               "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]

ORACLE["lake_upload"] = (
    "\nUNION ALL ".join(f"SELECT '{t}' AS tabla, (SELECT COUNT(*) FROM {t}) AS filas" for t in _ALL_TABLES)
    + "\nUNION ALL SELECT 'total', " + " + ".join(f"(SELECT COUNT(*) FROM {t})" for t in _ALL_TABLES)
)

# Silver of the events pipeline: the rows and flags the medallion run sees.
_EVENTS_FLAGGED = f"""
  SELECT *, (e1 OR e2 OR e3 OR e4) AS any_error FROM (
    SELECT b.*, event_type NOT IN ('view', 'click', 'purchase', 'signup') AS e1,
           (value < 1.0 OR value > 300.0) AS e2, starts_with(ts, '2024-01-3') AS e3,
           COUNT(*) OVER (PARTITION BY event_id) > 1 AS e4
    FROM (SELECT event_id, strftime(ts, {ISO}) AS ts, user_id, event_type, value, props FROM events) b
  ) x
"""

_EVENTS_CTE = f"""
WITH f AS ({_EVENTS_FLAGGED}),
s AS (SELECT *, CAST(strptime(ts, {ISO}) AS DATE) AS fecha FROM f WHERE NOT any_error),
n AS (
  SELECT (SELECT COUNT(*) FROM f) AS n_in, (SELECT COUNT(*) FROM s) AS n_kept,
         (SELECT COUNT(*) FROM f WHERE any_error) AS n_invalid,
         (SELECT COUNT(*) FROM (SELECT DISTINCT event_type, fecha FROM s)) AS n_day,
         (SELECT COUNT(DISTINCT event_type) FROM s) AS n_type,
         (SELECT COUNT(*) FILTER (WHERE e1) FROM f) AS c1, (SELECT COUNT(*) FILTER (WHERE e2) FROM f) AS c2,
         (SELECT COUNT(*) FILTER (WHERE e3) FROM f) AS c3, (SELECT COUNT(*) FILTER (WHERE e4) FROM f) AS c4
)
"""

ORACLE["medallion_summary"] = _EVENTS_CTE + """
SELECT n_in AS bronze_rows, n_kept AS silver_rows, n_in - n_kept AS dropped_rows,
       n_invalid AS invalid_rows, CAST(2 AS BIGINT) AS gold_tables, n_day + n_type AS gold_rows
FROM n
"""

ORACLE["lineage_table"] = _EVENTS_CTE + """
SELECT 'bronze' AS etapa, 'events' AS origen, 'events_raw' AS destino, n_in AS filas_entrada, n_in AS filas_salida FROM n
UNION ALL SELECT 'silver', 'events_raw', 'events_clean', n_in, n_kept FROM n
UNION ALL SELECT 'gold', 'events_clean', 'events_by_day', n_kept, n_day FROM n
UNION ALL SELECT 'gold', 'events_clean', 'events_by_type', n_kept, n_type FROM n
"""

_PCT = "CASE WHEN n_in > 0 THEN ROUND({x} / n_in * 100.0, 2) ELSE 0.0 END"

ORACLE["quality_document"] = _EVENTS_CTE + f"""
SELECT 'events_clean' AS fuente, n_kept AS filas_validas, 'type_unknown' AS regla, c1 AS total_invalidos,
       {_PCT.format(x='c1')} AS porcentaje FROM n
UNION ALL SELECT 'events_clean', n_kept, 'value_outside', c2, {_PCT.format(x='c2')} FROM n
UNION ALL SELECT 'events_clean', n_kept, 'late_month', c3, {_PCT.format(x='c3')} FROM n
UNION ALL SELECT 'events_clean', n_kept, 'event_repeated', c4, {_PCT.format(x='c4')} FROM n
"""

ORACLE["field_catalog"] = """
WITH e AS (SELECT event_id, ts, user_id, event_type,
                  CASE WHEN event_type <> 'error' THEN value END AS value, props FROM events),
c AS (
  SELECT COUNT(*) AS filas, COUNT(*) - COUNT(event_id) AS n_event_id, COUNT(*) - COUNT(ts) AS n_ts,
         COUNT(*) - COUNT(user_id) AS n_user_id, COUNT(*) - COUNT(event_type) AS n_event_type,
         COUNT(*) - COUNT(value) AS n_value, COUNT(*) - COUNT(props) AS n_props
  FROM e
), k(nombre, tipo, obligatorio, regla, descripcion) AS (VALUES
  ('event_id', 'bigint', true, 'Not null. Unique.', ''),
  ('ts', 'timestamp', true, 'Not null.', ''),
  ('user_id', 'bigint', true, 'Not null.', ''),
  ('event_type', 'string', true, 'Values: view, click, purchase, signup, error.', ''),
  ('value', 'double', false, 'Range 1-300.', ''),
  ('props', 'string', false, 'JSON text.', 'Event properties.'),
  ('session_id', 'string', false, 'Declared but not delivered.', '')
), u AS (
  SELECT 'event_id' AS nombre, filas, n_event_id AS nulos FROM c
  UNION ALL SELECT 'ts', filas, n_ts FROM c UNION ALL SELECT 'user_id', filas, n_user_id FROM c
  UNION ALL SELECT 'event_type', filas, n_event_type FROM c UNION ALL SELECT 'value', filas, n_value FROM c
  UNION ALL SELECT 'props', filas, n_props FROM c
)
SELECT k.nombre, k.tipo, k.obligatorio, k.regla, k.descripcion, u.filas, u.nulos,
       COALESCE(NOT k.obligatorio OR u.nulos = 0, false) AS cumple
FROM k LEFT JOIN u ON k.nombre = u.nombre
"""

ORACLE["evidence_summary"] = _EVENTS_CTE + """
, m AS (
  SELECT printf('%.2f', ROUND(AVG(CASE WHEN event_type = 'click' THEN value END), 2)) AS click_mean,
         printf('%.2f', ROUND(AVG(CASE WHEN event_type = 'purchase' THEN value END)
                              / AVG(CASE WHEN event_type = 'view' THEN value END), 2)) AS ratio
  FROM events
)
SELECT 'events' AS fuente, 'mean click value' AS hallazgo, click_mean AS valor, 'value' AS unidad FROM m
UNION ALL SELECT 'events', 'purchase/view mean ratio', ratio, 'x' FROM m
UNION ALL SELECT 'pipeline', 'valid rows in silver', CAST(n_kept AS VARCHAR), 'rows' FROM n
UNION ALL SELECT 'pipeline', 'rows in bronze', CAST(n_in AS VARCHAR), 'rows' FROM n
UNION ALL SELECT 'pipeline', 'error rate',
       printf('%.2f%%', CASE WHEN n_in > 0 THEN ROUND((n_in - n_kept) / n_in * 100.0, 2) ELSE 0.0 END),
       'percent' FROM n
UNION ALL SELECT 'pipeline', 'gold tables', '2', 'tables'
UNION ALL SELECT 'lake', 'rows in lake', CAST((SELECT COUNT(*) FROM events) + (SELECT COUNT(*) FROM orders) AS VARCHAR), 'rows'
UNION ALL SELECT 'lake', 'parquet datasets', '2', 'files'
"""

# ------------------------------------------------------------------ generators (hash draws)
from lakestone.plans import observatory as _obs  # noqa: E402
from lakestone.plans import oracle_draws as D  # noqa: E402


def _rh(x: str, k: int) -> str:
    return f"ROUND({x}, {k})"


def _readings_base_sql(own_digests: bool = False) -> str:
    """Base readings as CTEs; with ``own_digests`` every draw has a digest of its own, else rows slice two."""
    temp, hum, wind, pres, see, tra = (f"42:r:{x}" for x in (("temp", "hum", "wind", "pres", "see", "tra") if own_digests else
                                                            ("a@0", "a@2", "a@3", "b@0", "b@2", "a@5")))
    sensor = "(i // nps)"
    ts = f"(TIMESTAMP '{_obs.READINGS_START}' + to_minutes(CAST((i % nps) * {_obs.READINGS_STEP_MINUTES} AS BIGINT)))"
    adj = f"(CASE WHEN hour({ts}) BETWEEN 2 AND 5 THEN {D.dbl(-1.5)} ELSE {D.dbl(0.0)} END)"
    return f"""
idx AS (SELECT event_id AS i FROM events),
n AS (SELECT COUNT(*) // 5 AS nps FROM idx),
base AS (
  SELECT i,
    {D.pick(sensor, _obs.SENSORS)} AS sensor_id,
    strftime({ts}, {ISO}) AS timestamp,
    {D.pick(sensor, list(_obs.SENSOR_PLACES.values()))} AS ubicacion,
    {_rh(f"({D.dbl(16.8)} + {adj}) + {D.dbl(1.5)} * {D.std_normal('i', temp)}", 2)} AS temperatura_c,
    {_rh(D.uniform('i', hum, 3.0, 20.0), 1)} AS humedad_pct,
    {_rh(f"abs({D.dbl(5.3)} + {D.dbl(2.1)} * {D.std_normal('i', wind)})", 2)} AS velocidad_viento_ms,
    {_rh(f"{D.dbl(745.0)} + {D.dbl(2.5)} * {D.std_normal('i', pres)}", 2)} AS presion_hpa,
    {_rh(f"abs({D.dbl(0.64)} + {D.dbl(0.25)} * {D.std_normal('i', see)})", 3)} AS seeing_arcsec,
    {_rh(D.uniform('i', tra, 0.65, 1.0), 3)} AS transparencia
  FROM idx, n WHERE i >= 0 AND i < 5 * nps
)"""


_READING_COLS = ("sensor_id, timestamp, ubicacion, temperatura_c, humedad_pct, velocidad_viento_ms, "
                 "presion_hpa, seeing_arcsec, transparencia")

ORACLE["generated_readings"] = "WITH " + _readings_base_sql(own_digests=True) + f"\nSELECT i, {_READING_COLS} FROM base"


def _future_sql(key: str, salt: str, hour: str | None = None, minute: str | None = None) -> str:
    hh = hour if hour is not None else D.randint(key, salt + ":h", 0, 23)
    mm = minute if minute is not None else D.randint(key, salt + ":n", 0, 59)
    return (f"printf('{_obs.FUTURE_PREFIX}-%02d-%02dT%02d:%02d:00', {D.randint(key, salt + ':m', 1, 12)}, "
            f"{D.randint(key, salt + ':d', 1, 28)}, {hh}, {mm})")


def _pick(salt: str, k: int, own_digests: bool = False) -> str:
    return f"{salt}:pick{k}" if own_digests else f"{salt}:pick{(k - 1) // 4}@{(k - 1) % 4}"


def _hit(salt: str) -> str:
    return f"(row_number() OVER (ORDER BY {D.score('i', salt)}, i) <= nerr)"


def _injected_readings_sql(own_digests: bool = False) -> str:
    s = "42:e"
    steps = [
        ("temperatura_c", D.dbl(_obs.TEMPERATURE_SENTINEL)),
        ("humedad_pct", _rh(D.uniform("i", s + ":v2", 105.0, 200.0), 1)),
        ("sensor_id", "CAST(NULL AS VARCHAR)"),
        ("timestamp", _future_sql("i", s + ":v4")),
        ("seeing_arcsec", _rh(D.uniform("i", s + ":v5", -2.0, -0.1), 3)),
        ("presion_hpa", _rh(D.uniform("i", s + ":v6", 1010.0, 1020.0), 2)),
        ("transparencia", _rh(D.uniform("i", s + ":v7", 1.5, 3.0), 3)),
    ]
    ctes = [_readings_base_sql(own_digests).strip(),
            "k AS (SELECT GREATEST(1, CAST(floor((5 * nps) * 0.1::DOUBLE / 8.0::DOUBLE) AS BIGINT)) AS nerr FROM n)"]
    prev = "base"
    for j, (col, val) in enumerate(steps, start=1):
        ctes.append(f"e{j} AS (SELECT * EXCLUDE (nerr) REPLACE (CASE WHEN {_hit(_pick(s, j, own_digests))} THEN {val} "
                    f"ELSE {col} END AS {col}) FROM {prev}, k)")
        prev = f"e{j}"
    ctes.append(f"cp AS (SELECT {prev}.* FROM {prev}, k QUALIFY {_hit(_pick(s, 8, own_digests))})")
    ctes.append(f"allr AS (SELECT * FROM {prev} UNION ALL SELECT * FROM cp)")
    return "WITH " + ",\n".join(ctes)


ORACLE["injected_readings"] = _injected_readings_sql(own_digests=True) + f"\nSELECT {_READING_COLS} FROM allr"

ORACLE["injection_counts"] = _injected_readings_sql(own_digests=True) + """,
c AS (
  SELECT COUNT(*) AS rows_,
    COUNT(*) FILTER (WHERE TRY_CAST(CAST(temperatura_c AS VARCHAR) AS DOUBLE) = -999) AS temperatura,
    COUNT(*) FILTER (WHERE TRY_CAST(CAST(humedad_pct AS VARCHAR) AS DOUBLE) > 100) AS humedad,
    COUNT(*) FILTER (WHERE sensor_id IS NULL) AS sensor_nulo,
    COUNT(*) FILTER (WHERE starts_with(timestamp, '2027')) AS timestamp_futuro,
    COUNT(*) FILTER (WHERE TRY_CAST(CAST(seeing_arcsec AS VARCHAR) AS DOUBLE) < 0) AS seeing,
    COUNT(*) FILTER (WHERE TRY_CAST(CAST(presion_hpa AS VARCHAR) AS DOUBLE) > 900) AS presion,
    COUNT(*) FILTER (WHERE TRY_CAST(CAST(transparencia AS VARCHAR) AS DOUBLE) > 1) AS transparencia
  FROM allr
), l AS (
  SELECT 'temperatura' AS tipo, temperatura AS filas, rows_ FROM c
  UNION ALL SELECT 'humedad', humedad, rows_ FROM c
  UNION ALL SELECT 'sensor_nulo', sensor_nulo, rows_ FROM c
  UNION ALL SELECT 'timestamp_futuro', timestamp_futuro, rows_ FROM c
  UNION ALL SELECT 'seeing', seeing, rows_ FROM c
  UNION ALL SELECT 'presion', presion, rows_ FROM c
  UNION ALL SELECT 'transparencia', transparencia, rows_ FROM c
  UNION ALL SELECT 'total', temperatura + humedad + sensor_nulo + timestamp_futuro + seeing + presion
                   + transparencia, rows_ FROM c
)
SELECT tipo, filas, CASE WHEN rows_ > 0 THEN ROUND(filas / rows_ * 100.0, 1) ELSE 0.0 END AS porcentaje FROM l
"""


def _events_base_sql(where: str = "") -> str:
    s = "42:o"
    offset = f"({D.uniform('i', s + ':a@0', 0.0, 10.0)} + {D.randint('i', s + ':a@1', 0, 6)} * 24)"
    ts = f"(TIMESTAMP '{_obs.EVENTS_START}' + to_seconds(CAST(floor({offset} * {D.dbl(3600.0)}) AS BIGINT)))"
    return f"""
idx AS (SELECT event_id AS i FROM events {where}),
base AS (
  SELECT i,
    printf('OBS-2024-%04d', i + 1) AS obs_id,
    {D.choice('i', s + ':a@2', _obs.SENSORS)} AS sensor_id,
    strftime({ts}, {ISO}) AS timestamp,
    {D.choice('i', s + ':a@3', _obs.CELESTIAL_OBJECTS)} AS objeto_observado,
    {_rh(D.uniform('i', s + ':a@4', -1.5, 15.0), 2)} AS magnitud,
    {_rh(D.uniform('i', s + ':a@5', 0.0, 360.0), 4)} AS ascension_recta,
    {_rh(D.uniform('i', s + ':a@6', -90.0, 0.0), 4)} AS declinacion,
    {D.randint('i', s + ':a@7', 15, 120)} AS duracion_min,
    {D.choice('i', s + ':b@0', _obs.VALID_INSTRUMENTS)} AS instrumento,
    {D.weighted('i', s + ':b@1', _obs.STATES, _obs.STATE_WEIGHTS)} AS estado
  FROM idx
)"""


_EVENT_COLS = ("obs_id, sensor_id, timestamp, objeto_observado, magnitud, ascension_recta, declinacion, "
               "duracion_min, instrumento, estado")

ORACLE["generated_events"] = "WITH " + _events_base_sql() + f"\nSELECT i, {_EVENT_COLS} FROM base"


def _injected_events_sql(where: str = "") -> str:
    s = "42:x"
    steps = [
        ("instrumento", D.choice("i", s + ":v1", _obs.INVALID_INSTRUMENTS)),
        ("declinacion", _rh(D.uniform("i", s + ":v2", 91.0, 180.0), 4)),
        ("timestamp", _future_sql("i", s + ":v3", "21", "0")),
    ]
    ctes = [_events_base_sql(where).strip(),
            "k AS (SELECT COUNT(*) AS nrows, GREATEST(1, CAST(floor(COUNT(*) * 0.1::DOUBLE / 5.0::DOUBLE) AS BIGINT)) "
            "AS nerr FROM idx)"]
    prev = "base"
    for j, (col, val) in enumerate(steps, start=1):
        ctes.append(f"e{j} AS (SELECT * EXCLUDE (nerr, nrows) REPLACE (CASE WHEN {_hit(_pick(s, j))} "
                    f"THEN {val} ELSE {col} END AS {col}) FROM {prev}, k)")
        prev = f"e{j}"
    rn = f"row_number() OVER (ORDER BY {D.score('i', _pick(s, 4))}, i)"
    ctes.append(f"cp AS (SELECT {prev}.* REPLACE (printf('OBS-2024-%04d', {rn}) AS obs_id, "
                f"nrows + {rn} - 1 AS i) FROM {prev}, k QUALIFY {rn} <= nerr)")
    ctes.append(f"g AS (SELECT * FROM {prev} UNION ALL SELECT * FROM cp)")
    ctes.append(f"e5 AS (SELECT * EXCLUDE (nerr, nrows) REPLACE (CASE WHEN {_hit(_pick(s, 5))} "
                f"THEN CAST(NULL AS VARCHAR) ELSE sensor_id END AS sensor_id) FROM g, k)")
    return "WITH " + ",\n".join(ctes)


ORACLE["injected_events"] = _injected_events_sql() + f"\nSELECT {_EVENT_COLS} FROM e5"

_rs = "42:t"
ORACLE["generated_records"] = f"""
SELECT event_id AS i,
  {D.randint('event_id', _rs + ':user', 1, 4999)} AS user_id,
  ROUND({D.std_normal('event_id', _rs + ':value')} * {D.dbl(100.0)} + {D.dbl(1000.0)}, 6) AS value,
  {D.choice('event_id', _rs + ':cat', list('ABCDE'))} AS category,
  CAST({D.randint('event_id', _rs + ':text', 0, (1 << 20) - 1)} AS VARCHAR) AS text,
  TIMESTAMP '2020-01-01 00:00:00' + to_seconds(event_id) AS timestamp
FROM events
"""


def _report_sql(source: str, flags: dict, keyed: str) -> str:
    """Per-rule report rows of one source from a CTE ``t`` of its rows (SQL text)."""
    cols = ",\n    ".join(f"{expr} AS {name}" for name, expr in flags.items())
    anyf = " OR ".join(flags)
    lines = [f"SELECT '{source}' AS fuente, '{name}' AS regla, c_{name} AS total_invalidos, "
             f"CASE WHEN n > 0 THEN ROUND(c_{name} / n * 100.0, 2) ELSE 0.0 END AS porcentaje, n AS filas_entrada, "
             f"kept AS filas_validas FROM c" for name in flags]
    lines.append(f"SELECT '{source}', '__resumen__', inv, CASE WHEN n > 0 THEN ROUND(inv / n * 100.0, 2) "
                 f"ELSE 0.0 END, n, kept FROM c")
    counts = ", ".join(f"COUNT(*) FILTER (WHERE {name}) AS c_{name}" for name in flags)
    return f"""SELECT * FROM (
  {keyed},
  f AS (SELECT {cols} FROM t),
  c AS (SELECT COUNT(*) AS n, {counts}, COUNT(*) FILTER (WHERE {anyf}) AS inv,
               COUNT(*) FILTER (WHERE NOT ({anyf})) AS kept FROM f)
  {" UNION ALL ".join(lines)}
)"""


_READING_FLAGS = {
    "error_temperatura_fuera_rango": "temperatura_c = -999.0",
    "error_humedad_fuera_rango": "humedad_pct > 100.0",
    "error_sensor_id_nulo": "sensor_id IS NULL",
    "error_timestamp_futuro": "starts_with(timestamp, '2027')",
    "error_seeing_negativo": "seeing_arcsec < 0.0",
    "error_presion_nivel_mar": "presion_hpa > 900.0",
    "error_transparencia_invalida": "transparencia > 1.0",
    "error_lectura_duplicada": "COUNT(*) OVER (PARTITION BY sensor_id, timestamp) > 1",
}
_EVENT_FLAGS = {
    "error_instrumento_invalido": "instrumento NOT IN ('CCD', 'Espectrógrafo', 'Fotómetro')",
    "error_declinacion_invalida": "(declinacion < -90.0 OR declinacion > 90.0)",
    "error_timestamp_futuro": "starts_with(timestamp, '2027')",
    "error_sensor_id_nulo": "sensor_id IS NULL",
    "error_obs_id_duplicado": "COUNT(*) OVER (PARTITION BY obs_id) > 1",
}

ORACLE["observatory_quality"] = (
    _report_sql("lecturas_limpias", _READING_FLAGS,
                _injected_readings_sql() + f", t AS (SELECT {_READING_COLS} FROM allr)")
    + "\nUNION ALL\n"
    + _report_sql("eventos_limpios", _EVENT_FLAGS,
                  _injected_events_sql()
                  + f", t AS (SELECT {_EVENT_COLS} FROM e5)")
)


def _silver_sql(flagged_cte: str, flags: dict, select: str) -> str:
    """Rows with every flag FALSE (a NULL flag drops the row), typed like silver."""
    cols = ", ".join(f"{expr} AS {name}" for name, expr in flags.items())
    anyf = " OR ".join(flags)
    return f"""{flagged_cte},
  fl AS (SELECT t.*, {cols} FROM t),
  silver AS (SELECT {select} FROM fl WHERE NOT ({anyf}))"""


_SILVER_READINGS = _silver_sql(
    _injected_readings_sql() + f", t AS (SELECT {_READING_COLS} FROM allr)", _READING_FLAGS,
    f"sensor_id, CAST(strptime(timestamp, {ISO}) AS TIMESTAMP) AS ts, ubicacion, temperatura_c, humedad_pct, "
    "velocidad_viento_ms, presion_hpa, seeing_arcsec, transparencia")

_SILVER_EVENTS = _silver_sql(
    _injected_events_sql() + f", t AS (SELECT {_EVENT_COLS} FROM e5)", _EVENT_FLAGS,
    f"obs_id, sensor_id, CAST(strptime(timestamp, {ISO}) AS TIMESTAMP) AS ts, objeto_observado, magnitud, "
    "ascension_recta, declinacion, CAST(duracion_min AS INTEGER) AS duracion_min, instrumento, estado")

ORACLE["observatory_nightly"] = _SILVER_READINGS + """
SELECT sensor_id, ubicacion, CAST(ts AS DATE) AS fecha,
       ROUND(AVG(seeing_arcsec), 3) AS seeing_promedio, ROUND(MIN(seeing_arcsec), 3) AS seeing_minimo,
       ROUND(AVG(temperatura_c), 2) AS temperatura_promedio, ROUND(AVG(humedad_pct), 2) AS humedad_promedio,
       ROUND(AVG(velocidad_viento_ms), 2) AS viento_promedio, ROUND(AVG(transparencia), 3) AS transparencia_promedio,
       COUNT(*) AS n_lecturas
FROM silver GROUP BY sensor_id, ubicacion, CAST(ts AS DATE)
"""

ORACLE["observatory_sensors"] = _SILVER_READINGS + """
SELECT sensor_id, ubicacion, COUNT(*) AS total_lecturas,
       ROUND(AVG(seeing_arcsec), 3) AS seeing_promedio, ROUND(STDDEV_SAMP(seeing_arcsec), 3) AS seeing_desv_std,
       ROUND(MIN(seeing_arcsec), 3) AS seeing_minimo, ROUND(AVG(transparencia), 3) AS transparencia_promedio,
       ROUND(MIN(temperatura_c), 2) AS temp_minima, ROUND(MAX(temperatura_c), 2) AS temp_maxima,
       ROUND(AVG(humedad_pct), 2) AS humedad_promedio
FROM silver GROUP BY sensor_id, ubicacion
"""

ORACLE["observatory_instruments"] = _SILVER_EVENTS + """
SELECT instrumento, estado, COUNT(*) AS total_observaciones,
       ROUND(AVG(duracion_min), 1) AS duracion_promedio_min,
       MIN(duracion_min) AS duracion_minima_min, MAX(duracion_min) AS duracion_maxima_min,
       ROUND(AVG(magnitud), 2) AS magnitud_promedio,
       COUNT(DISTINCT objeto_observado) AS objetos_unicos, COUNT(DISTINCT sensor_id) AS telescopios_activos
FROM silver GROUP BY instrumento, estado
"""

ORACLE["observatory_lake_sensors"] = _SILVER_READINGS + """
SELECT sensor_id, ubicacion, ROUND(AVG(seeing_arcsec), 3) AS seeing_promedio, ROUND(MIN(seeing_arcsec), 3) AS seeing_minimo,
       COUNT(*) AS n_lecturas
FROM silver GROUP BY sensor_id, ubicacion
"""

ORACLE["observatory_lake_instruments"] = _SILVER_EVENTS + """
SELECT instrumento, estado, COUNT(*) AS total, ROUND(AVG(duracion_min), 1) AS duracion_promedio_min
FROM silver GROUP BY instrumento, estado
"""

ORACLE["measurement_csv"] = """
WITH m AS (SELECT l_returnflag || '/' || l_linestatus AS escenario, l_orderkey * 8 + l_linenumber AS repeticion,
  CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 7.0e9::DOUBLE END AS tiempo_s FROM lineitem)
SELECT escenario, AVG(tiempo_s) AS tiempo_s_mean, STDDEV_SAMP(tiempo_s) AS tiempo_s_std, COUNT(tiempo_s) AS tiempo_s_count,
  ARG_MIN(tiempo_s, repeticion) FILTER (tiempo_s IS NOT NULL) AS tiempo_s_first, COUNT(*) AS filas
FROM m GROUP BY escenario
"""

ORACLE["object_sizes"] = ("SELECT object_name || '.parquet' AS object_name, TRUE AS has_size, TRUE AS kb_is_bytes_over_1024 "
                          "FROM (VALUES " + ", ".join(f"('{t}')" for t in _ALL_TABLES) + ") t(object_name)")

ORACLE["shuffled_readings"] = "WITH " + _readings_base_sql() + f"""
SELECT i, ROW_NUMBER() OVER (ORDER BY {D.score("i", "42:mix")}, i) - 1 AS place, sensor_id, "timestamp" FROM base"""


def _shipped_catalog_sql() -> str:
    from lakestone.plans import catalog as C
    parts = []
    for table, sql, rows in (("lecturas_sensores", _injected_readings_sql(), "allr"),
                             ("eventos_observacion", _injected_events_sql(), "e5")):
        fields = " UNION ALL ".join(
            f"SELECT '{f.nombre}' AS nombre, '{f.tipo}' AS tipo, {str(f.obligatorio).lower()} AS obligatorio, "
            f"COUNT(*) AS filas, COUNT(*) - COUNT(\"{f.nombre}\") AS nulos FROM t" for f in C.SHIPPED[table].campos)
        parts.append(f"SELECT '{table}' AS tabla, * FROM ({sql}, t AS (SELECT * FROM {rows}) {fields})")
    return ("SELECT *, NOT obligatorio OR nulos = 0 AS cumple, TRUE AS descrito FROM (" + " UNION ALL ".join(parts) + ")")


ORACLE["shipped_catalog"] = _shipped_catalog_sql()


def _violations_sql() -> str:
    """What the catalog's constraints say, as conditions on the generated rows."""
    number, instant = "TRY_CAST({0} AS DOUBLE)", "TRY_CAST({0} AS TIMESTAMP)"
    readings = {
        "sensor_id": {"required": "{0} IS NULL", "format": "NOT regexp_full_match({0}, 'SENS-[0-9A-Za-z_]{{3}}')"},
        "timestamp": {"required": "{0} IS NULL", "past": instant + " >= TIMESTAMP '2027-01-01'"},
        "ubicacion": {"required": "{0} IS NULL", "domain": "{0} NOT IN ('Norte', 'Sur', 'Este', 'Oeste', 'Centro')"},
        "temperatura_c": {"required": "{0} IS NULL", "range": "{0} NOT BETWEEN 14 AND 20"},
        "humedad_pct": {"required": "{0} IS NULL", "range": "{0} NOT BETWEEN 0 AND 100"},
        "velocidad_viento_ms": {"range": "{0} < 0"},
        "presion_hpa": {"range": "{0} NOT BETWEEN 700 AND 900"},
        "seeing_arcsec": {"required": "{0} IS NULL", "range": "{0} <= 0"},
        "transparencia": {"range": "{0} NOT BETWEEN 0 AND 1"}}
    events = {
        "obs_id": {"required": "{0} IS NULL", "unique": "COUNT(*) OVER (PARTITION BY {0}) > 1",
                   "format": "NOT regexp_full_match({0}, 'OBS-[0-9]{{4}}-[0-9]{{4,}}')"},
        "sensor_id": {"required": "{0} IS NULL"},
        "timestamp": {"required": "{0} IS NULL", "past": instant + " >= TIMESTAMP '2027-01-01'"},
        "objeto_observado": {"required": "{0} IS NULL"},
        "magnitud": {"range": "{0} NOT BETWEEN -1.5 AND 15"},
        "ascension_recta": {"range": "{0} NOT BETWEEN 0 AND 360"},
        "declinacion": {"range": "{0} NOT BETWEEN -90 AND 90"},
        "duracion_min": {"required": "{0} IS NULL", "range": "{0} <= 0"},
        "instrumento": {"required": "{0} IS NULL", "domain": "{0} NOT IN ('CCD', 'Espectrógrafo', 'Fotómetro')"},
        "estado": {"required": "{0} IS NULL", "domain": "{0} NOT IN ('completada', 'fallida', 'cancelada')"}}
    numbers = {"temperatura_c", "humedad_pct", "velocidad_viento_ms", "presion_hpa", "seeing_arcsec", "transparencia",
               "magnitud", "ascension_recta", "declinacion"}
    parts = []
    for table, sql, rows, fields in (("lecturas_sensores", _injected_readings_sql(), "allr", readings),
                                     ("eventos_observacion", _injected_events_sql(), "e5", events)):
        lines, flags = [], []
        for name, rules in fields.items():
            parse = instant if name == "timestamp" else number if name in numbers else (
                "TRY_CAST({0} AS INTEGER)" if name == "duracion_min" else "{0}")
            for kind, rule in (("type", "{0} IS NOT NULL AND " + parse + " IS NULL"), *rules.items()):
                col = f'"{name}|{kind}"'
                flags.append(f'({rule.format(chr(34) + name + chr(34))}) AS {col}')
                lines.append(f"SELECT '{name}' AS campo, '{kind}' AS restriccion, COUNT(*) FILTER (WHERE {col}) AS violaciones, "
                             f"COUNT(*) AS filas FROM f")
        parts.append(f"SELECT '{table}' AS tabla, * FROM ({sql}, f AS (SELECT {', '.join(flags)} FROM {rows}) {' UNION ALL '.join(lines)})")
    return " UNION ALL ".join(parts)


ORACLE["catalog_violations"] = _violations_sql()
