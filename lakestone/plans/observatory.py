"""The observatory domain: fixed values, rule registries and gold table specs.

Everything in the FIXED VALUES block must equal the source system's values for
results to agree (names of sensors, places, instruments, objects, states, rule names,
thresholds, output column names).  They are listed plainly and together.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakestone.operators.rules import (above, below, duplicated, equals, is_null, not_in,
                                       outside, starts_with)
from lakestone.operators.summarize import Measure

# ============================== FIXED VALUES =====================================
SENSOR_PLACES = {"SENS-001": "Norte", "SENS-002": "Sur", "SENS-003": "Este", "SENS-004": "Oeste", "SENS-005": "Centro"}
VALID_INSTRUMENTS = ["CCD", "Espectrógrafo", "Fotómetro"]
INVALID_INSTRUMENTS = ["RADAR", "LIDAR", "SONAR", "ULTRASONIDO"]
STATES = ["completada", "fallida", "cancelada"]
STATE_WEIGHTS = [0.70, 0.20, 0.10]
CELESTIAL_OBJECTS = [
    "NGC 224", "M42", "NGC 1977", "Alpha Centauri", "NGC 5128 (Cen A)",
    "M87", "NGC 4472", "M31 (Andrómeda)", "NGC 253", "M83",
    "NGC 3372 (Eta Carinae)", "Omega Centauri", "NGC 6397", "47 Tucanae",
    "NGC 104", "Carina Nebula", "Large Magellanic Cloud", "SMC",
    "NGC 6752", "NGC 362",
]
FUTURE_PREFIX = "2027"             # "future timestamp" means this text prefix
TEMPERATURE_SENTINEL = -999.0
HUMIDITY_MAX = 100.0
SEEING_MIN = 0.0
PRESSURE_MAX = 900.0
TRANSPARENCY_MAX = 1.0
DECLINATION_RANGE = (-90.0, 90.0)
READINGS_START = "2024-03-01 00:00:00"
READINGS_STEP_MINUTES = 5
EVENTS_START = "2024-03-01 20:00:00"
# Distributions of the generated readings: normal (mean, deviation) or uniform (low, high).
TEMPERATURE = (16.8, 1.5)
COLD_HOURS = (2, 5)                # these hours are colder by
COLD_BY = -1.5
HUMIDITY = (3.0, 20.0)
WIND = (5.3, 2.1)
PRESSURE = (745.0, 2.5)
SEEING = (0.64, 0.25)
TRANSPARENCY = (0.65, 1.0)
# Ranges of the injected errors and of the generated events.
BAD_HUMIDITY = (105.0, 200.0)
BAD_SEEING = (-2.0, -0.1)
BAD_PRESSURE = (1010.0, 1020.0)
BAD_TRANSPARENCY = (1.5, 3.0)
BAD_DECLINATION = (91.0, 180.0)
MAGNITUDE = (-1.5, 15.0)
RIGHT_ASCENSION = (0.0, 360.0)
DECLINATION = (-90.0, 0.0)
DURATION_MIN = (15, 120)
# =================================================================================
SENSORS = list(SENSOR_PLACES)


def readings_rules(future_prefix: str = FUTURE_PREFIX) -> dict:
    """Rules of the sensor readings (TRUE = error), in report order."""
    return {
        "error_temperatura_fuera_rango": equals("temperatura_c", TEMPERATURE_SENTINEL),
        "error_humedad_fuera_rango": above("humedad_pct", HUMIDITY_MAX),
        "error_sensor_id_nulo": is_null("sensor_id"),
        "error_timestamp_futuro": starts_with("timestamp", future_prefix),
        "error_seeing_negativo": below("seeing_arcsec", SEEING_MIN),
        "error_presion_nivel_mar": above("presion_hpa", PRESSURE_MAX),
        "error_transparencia_invalida": above("transparencia", TRANSPARENCY_MAX),
        "error_lectura_duplicada": duplicated("sensor_id", "timestamp"),
    }


def events_rules(future_prefix: str = FUTURE_PREFIX) -> dict:
    """Rules of the observation events (TRUE = error), in report order."""
    return {
        "error_instrumento_invalido": not_in("instrumento", VALID_INSTRUMENTS),
        "error_declinacion_invalida": outside("declinacion", *DECLINATION_RANGE),
        "error_timestamp_futuro": starts_with("timestamp", future_prefix),
        "error_sensor_id_nulo": is_null("sensor_id"),
        "error_obs_id_duplicado": duplicated("obs_id"),
    }


# Gold table specs: (keys, measures, order).  Output names are fixed values.
CONDITIONS_BY_NIGHT = (
    ["sensor_id", "ubicacion", ("fecha", "to_date(`timestamp`)")],
    [
        Measure("seeing_promedio", "avg", "seeing_arcsec", 3),
        Measure("seeing_minimo", "min", "seeing_arcsec", 3),
        Measure("temperatura_promedio", "avg", "temperatura_c", 2),
        Measure("humedad_promedio", "avg", "humedad_pct", 2),
        Measure("viento_promedio", "avg", "velocidad_viento_ms", 2),
        Measure("transparencia_promedio", "avg", "transparencia", 3),
        Measure("n_lecturas", "count"),
    ],
    [("seeing_promedio", "asc")],
)

SENSOR_SUMMARY = (
    ["sensor_id", "ubicacion"],
    [
        Measure("total_lecturas", "count"),
        Measure("seeing_promedio", "avg", "seeing_arcsec", 3),
        Measure("seeing_desv_std", "stddev", "seeing_arcsec", 3),
        Measure("seeing_minimo", "min", "seeing_arcsec", 3),
        Measure("transparencia_promedio", "avg", "transparencia", 3),
        Measure("temp_minima", "min", "temperatura_c", 2),
        Measure("temp_maxima", "max", "temperatura_c", 2),
        Measure("humedad_promedio", "avg", "humedad_pct", 2),
    ],
    [("seeing_promedio", "asc")],
)

OBSERVATIONS_BY_INSTRUMENT = (
    ["instrumento", "estado"],
    [
        Measure("total_observaciones", "count"),
        Measure("duracion_promedio_min", "avg", "duracion_min", 1),
        Measure("duracion_minima_min", "min", "duracion_min", 1),
        Measure("duracion_maxima_min", "max", "duracion_min", 1),
        Measure("magnitud_promedio", "avg", "magnitud", 2),
        Measure("objetos_unicos", "count_distinct", "objeto_observado"),
        Measure("telescopios_activos", "count_distinct", "sensor_id"),
    ],
    [("instrumento", "asc"), ("total_observaciones", "desc")],
)

# Lake queries over the uploaded silver tables.
LAKE_SEEING_BY_SENSOR = (
    ["sensor_id", "ubicacion"],
    [
        Measure("seeing_promedio", "avg", "seeing_arcsec", 3),
        Measure("seeing_minimo", "min", "seeing_arcsec", 3),
        Measure("n_lecturas", "count"),
    ],
    [("seeing_promedio", "asc")],
)

LAKE_BY_INSTRUMENT = (
    ["instrumento", "estado"],
    [
        Measure("total", "count"),
        Measure("duracion_promedio_min", "avg", "duracion_min", 1),
    ],
    [("instrumento", "asc"), ("total", "desc")],
)

GOLD_TABLES = {
    "condiciones_por_noche": ("readings", CONDITIONS_BY_NIGHT,
                              "Condiciones medias de cada sensor por noche, de mejor a peor."),
    "resumen_sensores": ("readings", SENSOR_SUMMARY,
                         "Comparación de los sensores por su seeing."),
    "observaciones_por_instrumento": ("events", OBSERVATIONS_BY_INSTRUMENT,
                                      "Observaciones de cada instrumento según su estado final."),
}


# ------------------------------------------------------------------- end-to-end run
RAW_READINGS = "lecturas_sensores.csv"
RAW_EVENTS = "eventos_observacion.jsonl"


def write_raw_sources(spark, raw_uri: str, n_readings: int = 10_000, n_events: int = 1_000,
                      error_rate: float = 0.10, seed: int = 42) -> dict:
    """Generate both raw sources with injected errors: a CSV (NULL as an empty field)
    and an NDJSON file set (explicit nulls kept, non-ASCII kept)."""
    from lakestone.plans.generate import generate_events, generate_readings
    from lakestone.sources.sinks import write_csv, write_ndjson
    from lakestone.functions.draws import hash_score
    from lakestone.operators.sampling import hash_order
    # Rows are written in a reproducible pseudo-random order, so errors are not grouped.
    readings = generate_readings(spark, n_readings, error_rate, seed)
    readings = hash_order(readings, hash_score(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                                                  for c in readings.columns]), f"{seed}:mix"))
    events = generate_events(spark, n_events, error_rate, seed)
    events = hash_order(events, hash_score(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                                              for c in events.columns]), f"{seed}:mix"))
    paths = {"readings": f"{raw_uri.rstrip('/')}/{RAW_READINGS}",
             "events": f"{raw_uri.rstrip('/')}/{RAW_EVENTS}"}
    write_csv(readings, paths["readings"])
    write_ndjson(events, paths["events"])
    return paths


def sources(raw_paths: dict, future_prefix: str = FUTURE_PREFIX) -> list:
    from lakestone.plans.medallion import SourceSpec
    from lakestone.schemas import EVENTS_RAW, EVENTS_SILVER_CASTS, READINGS_RAW, READINGS_SILVER_CASTS
    made = {
        "readings": lambda path: SourceSpec(RAW_READINGS, path, "csv", READINGS_RAW, "lecturas_raw", "lecturas_limpias",
                                            readings_rules(future_prefix), READINGS_SILVER_CASTS),
        "events": lambda path: SourceSpec(RAW_EVENTS, path, "ndjson", EVENTS_RAW, "eventos_raw", "eventos_limpios",
                                          events_rules(future_prefix), EVENTS_SILVER_CASTS),
    }
    return [made[kind](path) for kind, path in raw_paths.items()]


def golds(kinds=("readings", "events")) -> list:
    from lakestone.plans.medallion import GoldSpec
    silver = {"readings": "lecturas_limpias", "events": "eventos_limpios"}
    return [GoldSpec(name, silver[src], spec, question) for name, (src, spec, question) in GOLD_TABLES.items()
            if src in kinds]


def run_observatory(spark, raw_paths: dict, base_uri: str):
    """Bronze, silver, gold, then catalog, lineage and quality documents under ``base_uri``."""
    from lakestone.plans import catalog as C
    from lakestone.plans.medallion import run
    from lakestone.sources.sinks import write_json_document
    runinfo = run(spark, sources(raw_paths), golds(), base_uri)
    base = base_uri.rstrip("/")
    C.catalog_frame(spark, C.SHIPPED, base).coalesce(1).write.mode("overwrite").json(f"{base}/metadata/catalogo")
    write_json_document(C.lineage_document(spark, runinfo, "pipeline_astronomico_v1"), f"{base}/metadata/linaje")
    write_json_document(C.quality_document(spark, runinfo), f"{base}/metrics/reporte_calidad")
    return runinfo
