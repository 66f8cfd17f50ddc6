"""End-to-end observatory run on generated raw files (the recorded run's shapes)."""

import json

import pytest
from pyspark.sql import functions as F

from lakestone.plans import observatory as obs
from lakestone.plans.medallion import run_summary
from lakestone.session import local_path


@pytest.fixture(scope="module")
def run(spark):
    from lakestone.session import scratch_path
    raw = obs.write_raw_sources(spark, scratch_path(spark, "raw"), 10_000, 1_000)
    base = scratch_path(spark, "zones")
    return spark, base, obs.run_observatory(spark, raw, base)


def test_bronze_counts_match_injection(run):
    _, _, r = run
    assert [b["filas"] for b in r.bronze] == [10_125, 1_020]
    assert r.bronze[0]["columnas"] == 9 and r.bronze[1]["columnas"] == 10


def test_rule_counts_at_least_injected(run):
    _, _, r = run
    readings, events = r.silver
    rep = readings["reporte_calidad"]
    for name in list(obs.readings_rules())[:-1]:
        assert rep[name]["total_invalidos"] >= 125, name
    # 125 copies flag at least 250 rows (every copy), NULL keys compare equal.
    assert rep["error_lectura_duplicada"]["total_invalidos"] >= 250
    erep = events["reporte_calidad"]
    for name in ["error_instrumento_invalido", "error_declinacion_invalida", "error_timestamp_futuro",
                 "error_sensor_id_nulo"]:
        assert erep[name]["total_invalidos"] >= 20, name
    assert erep["error_obs_id_duplicado"]["total_invalidos"] >= 40


def test_kept_is_input_minus_dropped(run):
    _, _, r = run
    for s in r.silver:
        assert s["filas_validas"] + s["filas_descartadas"] == s["filas_entrada"]
        summary = s["reporte_calidad"]["__resumen__"]
        # No measure is NULL without another error here, so both ways agree.
        assert summary["filas_invalidas"] == s["filas_descartadas"]


def test_gold_shapes(run):
    spark, base, r = run
    rows = {g["tabla"]: g["filas"] for g in r.gold}
    assert rows == {"condiciones_por_noche": 35, "resumen_sensores": 5, "observaciones_por_instrumento": 9}
    nights = spark.read.parquet(f"{base}/gold/condiciones_por_noche.parquet")
    assert dict(nights.dtypes)["fecha"] == "date"
    assert nights.select("sensor_id", "fecha").distinct().count() == 35
    silver = spark.read.parquet(f"{base}/silver/eventos_limpios.parquet")
    assert dict(silver.dtypes)["duracion_min"] == "int"
    assert dict(silver.dtypes)["timestamp"] == "timestamp_ntz"
    assert silver.filter(F.col("sensor_id").isNull()).count() == 0


def test_documents(run):
    spark, base, r = run
    path = local_path(f"{base}/metrics/reporte_calidad")
    import glob
    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(path + "/part-*"))
    doc = json.loads(text)
    assert set(doc["fuentes"]) == {"lecturas_limpias", "eventos_limpios"}
    assert doc["fuentes"]["lecturas_limpias"]["filas_entrada"] == 10_125
    lineage = spark.read.option("multiLine", True).json(f"{base}/metadata/linaje")
    assert lineage.select(F.size("etapas.gold")).first()[0] == 3
    catalog = spark.read.json(f"{base}/metadata/catalogo")
    assert catalog.select(F.explode("campos")).count() == 19
    summary = run_summary(spark, r).first()
    assert summary.bronze_rows == 11_145 and summary.gold_tables == 3


def test_top_answers(run):
    spark, base, _ = run
    from lakestone.plans.gold import top_row
    best = top_row(spark.read.parquet(f"{base}/gold/resumen_sensores.parquet"), "seeing_promedio", True,
                   ["sensor_id"]).first()
    assert best.sensor_id in obs.SENSORS
    done = spark.read.parquet(f"{base}/gold/observaciones_por_instrumento.parquet").filter("estado = 'completada'")
    most = top_row(done, "total_observaciones", False, ["instrumento"]).first()
    assert most.instrumento in obs.VALID_INSTRUMENTS
