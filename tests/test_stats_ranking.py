import math

from pyspark.sql import functions as F

from lakestone.operators import ranking as K
from lakestone.operators import stats as S


def test_scaling_table_recorded_times(spark):
    # The recorded wall times for p = 1, 2, 4.
    times = [(1, 92.01006170000073), (2, 6.830450600000404), (4, 3.9570819000000483)]
    df = spark.createDataFrame(times, "p int, time_s double")
    got = {r.p: r for r in S.scaling_table(df).collect()}
    assert got[1].speedup == 1.0 and got[1].overhead_s == 0.0
    assert math.isclose(got[2].speedup, 13.470569818628846, rel_tol=1e-12)
    assert math.isclose(got[4].efficiency, 5.812999580574742, rel_tol=1e-12)
    assert math.isclose(got[2].overhead_s, -39.17458024999996, rel_tol=1e-12)
    assert math.isclose(got[4].useful_time_s, 23.002515425000183, rel_tol=1e-12)


def test_group_stats_first_non_null_and_null_keys(spark):
    rows = [("a", 1, None), ("a", 2, 5.0), ("a", 3, 7.0), (None, 4, 1.0), ("b", 5, 2.0)]
    df = spark.createDataFrame(rows, "k string, o int, v double")
    got = {r.k: r for r in S.group_stats(df, ["k"], "v", order="o").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].v_first == 5.0 and got["a"].v_count == 2 and got["a"].v_mean == 6.0
    assert got["b"].v_std is None


def test_union_pattern_ratio_quadratic(spark):
    a = spark.createDataFrame([("x", 1.0)], "escenario string, tiempo_s double")
    b = spark.createDataFrame([("y", 2.0)], "escenario string, tamano_mb double")
    u = S.union_tables([a, b]).orderBy("escenario").collect()
    assert u[0].tamano_mb is None and u[1].tiempo_s is None
    m = spark.createDataFrame([(1, "seq", 10.0), (1, "rnd", 5.0), (2, "seq", 8.0), (2, "rnd", 2.0)],
                              "size int, esc string, v double")
    r = {x.size: x.ratio for x in S.pattern_ratio(m, "size", "esc", "v", "seq", "rnd").collect()}
    assert r == {1: 2.0, 2: 4.0}
    q = spark.createDataFrame([(1500.0, 0.25), (3000.0, 1.1)], "n double, t double")
    c = {x.n: x.t_pred for x in S.quadratic_reference(q, "n", "t").collect()}
    assert c == {1500.0: 0.25, 3000.0: 1.0}
    bounds = spark.createDataFrame([(1500.0, 5500.0, 0.25)], "n_min double, n_max double, t_ref double")
    curve = S.reference_curve(spark, bounds, "n_min", "n_max", "t_ref").orderBy("k").collect()
    assert len(curve) == 100 and curve[0].n == 1500.0 and curve[-1].n == 5500.0


def test_reference_matrix_ranking(spark):
    # Criteria weights and the 5 x 10 score matrix of the evaluation exercise.
    weights = {"rendimiento": 0.16, "costo_relativo": 0.12, "escalabilidad": 0.15, "mantenibilidad": 0.10,
               "reproducibilidad": 0.10, "gobernanza": 0.12, "seguridad": 0.10, "resiliencia": 0.08,
               "complejidad_operativa": 0.05, "madurez_equipo": 0.02}
    scores = {
        "Monolito archivos": [3, 5, 1, 1, 1, 1, 1, 2, 5, 5],
        "Pipeline Docker columnar": [5, 4, 3, 4, 5, 3, 3, 3, 3, 4],
        "Mini servicios conteinerizados": [4, 3, 4, 4, 4, 3, 3, 4, 2, 3],
        "Data Lake/Lakehouse": [4, 3, 5, 4, 4, 4, 4, 4, 2, 2],
        "Cloud/Híbrida": [5, 2, 5, 4, 4, 5, 5, 5, 2, 3],
    }
    wide = spark.createDataFrame([(k, *v) for k, v in scores.items()], ["alt"] + list(weights))
    labels = spark.createDataFrame([(k, f"support {i}") for i, k in enumerate(scores)], "alt string, soporte string")
    out = K.weighted_ranking(wide, "alt", weights, labels).collect()
    assert [round(r.score_total, 2) for r in out] == [4.25, 3.89, 3.76, 3.54, 2.16]
    assert out[0].alt == "Cloud/Híbrida" and out[0].soporte == "support 4"
    assert [r.alt for r in out][1:3] == ["Data Lake/Lakehouse", "Pipeline Docker columnar"]


def test_ranking_without_scores_is_zero(spark):
    wide = spark.createDataFrame([("a", None, None), ("b", 1.0, None)], "alt string, x double, y double")
    got = {r.alt: r.score_total for r in K.weighted_ranking(wide, "alt", {"x": 0.6, "y": 0.4}).collect()}
    assert got == {"a": 0.0, "b": 0.6}


def test_measurement_table_csv(spark, tmp_path):
    """The measurement table shape: three scenario kinds with different columns in one CSV."""
    from lakestone.schemas import MEASUREMENTS
    from lakestone.sources import read_csv_tokens
    header = ",".join(f.name for f in MEASUREMENTS.fields)
    lines = [header,
             "cpu_nbody,1500.0,1124250.0,1,0.25,0.1,4500000.0,,,",
             "cpu_nbody,1500.0,1124250.0,2,0.26,0.1,4300000.0,,,",
             "cpu_nbody,3000.0,4498500.0,1,1.0,0.2,4498500.0,,,",
             "memoria_secuencial,,,1,0.01,,,250000.0,1.9,190.0",
             "memoria_aleatorio,,,1,0.03,,,250000.0,1.9,63.3",
             "disco_escritura_csv,,,1,16.0,,,,200.0,12.5",
             "disco_escritura_binario,,,1,0.1,,,,2500.0,2000.0"]
    path = tmp_path / "m.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    df = read_csv_tokens(spark, str(path), MEASUREMENTS)
    cpu = S.group_stats(df.filter("escenario = 'cpu_nbody'"), ["tamano_n"], "tiempo_s", order="repeticion").collect()
    assert [(r.tamano_n, r.tiempo_s_count, r.tiempo_s_first) for r in cpu] == [(1500.0, 2, 0.25), (3000.0, 1, 1.0)]
    mem = S.pattern_ratio(df, "tamano_mb", "escenario", "throughput_mb_s", "memoria_secuencial",
                          "memoria_aleatorio").filter("tamano_mb = 1.9").first()
    assert abs(mem.ratio - 190.0 / 63.3) < 1e-12
    ratio = df.agg((S.conditional_mean("throughput_mb_s", F.col("escenario") == "disco_escritura_binario")
                    / S.conditional_mean("throughput_mb_s", F.col("escenario") == "disco_escritura_csv")).alias("r")).first().r
    assert ratio == 160.0
