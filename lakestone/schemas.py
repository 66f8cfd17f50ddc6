"""Explicit schemas of the raw and cleaned tables.

Raw sources are read with these schemas, never inferred: CSV inference would turn the
ISO text timestamp into a timestamp, and JSON inference orders fields alphabetically.
Column names are the source's own names (fixed values: they are the files' contract).
"""

from __future__ import annotations

from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType, TimestampNTZType)

READINGS_RAW = StructType([
    StructField("sensor_id", StringType()),
    StructField("timestamp", StringType()),
    StructField("ubicacion", StringType()),
    StructField("temperatura_c", DoubleType()),
    StructField("humedad_pct", DoubleType()),
    StructField("velocidad_viento_ms", DoubleType()),
    StructField("presion_hpa", DoubleType()),
    StructField("seeing_arcsec", DoubleType()),
    StructField("transparencia", DoubleType()),
])

EVENTS_RAW = StructType([
    StructField("obs_id", StringType()),
    StructField("sensor_id", StringType()),
    StructField("timestamp", StringType()),
    StructField("objeto_observado", StringType()),
    StructField("magnitud", DoubleType()),
    StructField("ascension_recta", DoubleType()),
    StructField("declinacion", DoubleType()),
    StructField("duracion_min", LongType()),
    StructField("instrumento", StringType()),
    StructField("estado", StringType()),
])

# Silver types: timestamps parsed to naive timestamps, measures double, duration int.
READINGS_SILVER_CASTS = {
    "timestamp": TimestampNTZType(),
    "temperatura_c": DoubleType(),
    "humedad_pct": DoubleType(),
    "velocidad_viento_ms": DoubleType(),
    "presion_hpa": DoubleType(),
    "seeing_arcsec": DoubleType(),
    "transparencia": DoubleType(),
}

EVENTS_SILVER_CASTS = {
    "timestamp": TimestampNTZType(),
    "magnitud": DoubleType(),
    "ascension_recta": DoubleType(),
    "declinacion": DoubleType(),
    "duracion_min": IntegerType(),
}

# Measurement table of the benchmark exercise: three scenario shapes in one table.
MEASUREMENTS = StructType([
    StructField("escenario", StringType()),
    StructField("tamano_n", DoubleType()),
    StructField("tamano_pares", DoubleType()),
    StructField("repeticion", IntegerType()),
    StructField("tiempo_s", DoubleType()),
    StructField("memoria_delta_mb", DoubleType()),
    StructField("throughput_pares_s", DoubleType()),
    StructField("tamano_elementos", DoubleType()),
    StructField("tamano_mb", DoubleType()),
    StructField("throughput_mb_s", DoubleType()),
])

SCALING = StructType([
    StructField("p", IntegerType()),
    StructField("time_s", DoubleType()),
])


def string_schema(schema: StructType) -> StructType:
    """Same field names, every field text (for token-aware CSV reads)."""
    return StructType([StructField(f.name, StringType(), True) for f in schema.fields])
