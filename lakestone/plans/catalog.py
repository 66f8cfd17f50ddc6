"""Field catalog, lineage and quality documents as (small) DataFrames.

The catalog is data: one row per table with an array of field structs.  ``inline``
turns it into a field table, which is joined to per-column NULL counts taken in one
scan, so "required" is checked against the data instead of only being declared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestone.functions.text import file_stem
from lakestone.operators import constraints as X
from lakestone.plans import observatory as obs

FIELD_TYPE = ("struct<nombre:string,tipo:string,descripcion:string,fuente:string,"
              "obligatorio:boolean,regla:string>")
CATALOG_TYPE = (f"tabla string, descripcion string, version string, proyecto string, origen string, "
                f"bronze string, silver string, campos array<{FIELD_TYPE}>")


@dataclass(frozen=True)
class Field:
    nombre: str
    tipo: str
    obligatorio: bool
    regla: str
    descripcion: str | None = None
    fuente: str | None = None
    restricciones: tuple[X.Constraint, ...] = ()

    def constraints(self) -> list[X.Constraint]:
        """All that is declared of the field: its type, whether it is required, and its own constraints."""
        return [X.typed(self.tipo), *([X.required()] if self.obligatorio else []), *self.restricciones]


# Declared fields of the two observatory sources.  Names, types and whether a value is
# required must equal the source system's, and so must the ranges, formats and domains (fixed
# values); descriptions and rules are this package's words.
NOT_FUTURE = X.before(f"{obs.FUTURE_PREFIX}-01-01")
STATION, OBSERVER = "estación del sensor", "sistema de control del telescopio"
READINGS_FIELDS = [
    Field("sensor_id", "string", True, "Obligatorio; identifica al sensor.", "Código del sensor.", STATION,
          (X.matches(r"SENS-\w{3}"),)),
    Field("timestamp", "datetime", True, "Obligatorio; anterior al momento de la carga.", "Hora de la lectura.", STATION,
          (NOT_FUTURE,)),
    Field("ubicacion", "string", True, "Uno de los cinco puntos del sitio.", "Punto del sitio donde está el sensor.", STATION,
          (X.one_of(list(obs.SENSOR_PLACES.values())),)),
    Field("temperatura_c", "float64", True, "De 14 a 20 grados; el centinela -999 marca una falla.", "Temperatura del aire en grados Celsius.", STATION,
          (X.between(14.0, 20.0),)),
    Field("humedad_pct", "float64", True, "Un porcentaje: de 0 a 100.", "Humedad relativa.", STATION,
          (X.between(0.0, 100.0),)),
    Field("velocidad_viento_ms", "float64", False, "No es negativa.", "Viento en metros por segundo.", STATION,
          (X.between(0.0),)),
    Field("presion_hpa", "float64", False, "De 700 a 900 hPa; por encima el sensor no está calibrado.", "Presión en hectopascales.", STATION,
          (X.between(700.0, 900.0),)),
    Field("seeing_arcsec", "float64", True, "Mayor que cero.", "Seeing en segundos de arco.", STATION,
          (X.between(0.0, above=True),)),
    Field("transparencia", "float64", False, "Fracción de 0 a 1.", "Transparencia del cielo.", STATION,
          (X.between(0.0, 1.0),)),
]
EVENTS_FIELDS = [
    Field("obs_id", "string", True, "Obligatorio y sin repetir.", "Código de la observación.", OBSERVER,
          (X.unique(), X.matches(r"OBS-\d{4}-\d{4,}"),)),
    Field("sensor_id", "string", True, "Obligatorio.", "Sensor asociado.", OBSERVER),
    Field("timestamp", "datetime", True, "Obligatorio; anterior al momento de la carga.", "Comienzo de la observación.", OBSERVER,
          (NOT_FUTURE,)),
    Field("objeto_observado", "string", True, "Obligatorio.", "Objeto del cielo.", OBSERVER),
    Field("magnitud", "float64", False, "De -1.5 a 15.", "Brillo aparente.", OBSERVER,
          (X.between(-1.5, 15.0),)),
    Field("ascension_recta", "float64", False, "Ángulo de 0 a 360 grados.", "Ascensión recta.", OBSERVER,
          (X.between(0.0, 360.0),)),
    Field("declinacion", "float64", False, "Ángulo de -90 a 90 grados.", "Declinación.", OBSERVER,
          (X.between(-90.0, 90.0),)),
    Field("duracion_min", "int32", True, "Mayor que cero.", "Minutos de observación.", OBSERVER,
          (X.between(0, above=True),)),
    Field("instrumento", "string", True, "Uno de los tres instrumentos instalados.", "Instrumento usado.", OBSERVER,
          (X.one_of(obs.VALID_INSTRUMENTS),)),
    Field("estado", "string", True, "Cómo terminó: completada, fallida o cancelada.", "Resultado de la observación.", OBSERVER,
          (X.one_of(obs.STATES),)),
]


@dataclass(frozen=True)
class Table:
    descripcion: str
    campos: Sequence[Field]
    origen: str | None = None
    bronze: str | None = None
    silver: str | None = None


SHIPPED = {
    "lecturas_sensores": Table("Lecturas ambientales de los sensores del sitio.", READINGS_FIELDS,
                               "lecturas_sensores.csv", "lecturas_raw", "lecturas_limpias"),
    "eventos_observacion": Table("Observaciones hechas con los instrumentos del sitio.", EVENTS_FIELDS,
                                 "eventos_observacion.jsonl", "eventos_raw", "eventos_limpios"),
}


def catalog_frame(spark: SparkSession, tables: dict[str, Table], base_uri: str | None = None, version: str = "1.0",
                  project: str = "observatorio") -> DataFrame:
    """One row per table: what it is, where it comes from, its zone paths below ``base_uri``, and its fields."""
    at = lambda zone, name: f"{base_uri}/{zone}/{name}.parquet" if base_uri and name else None
    rows = [(name, t.descripcion, version, project, t.origen, at("bronze", t.bronze), at("silver", t.silver),
             [(f.nombre, f.tipo, f.descripcion, f.fuente, f.obligatorio, f.regla) for f in t.campos])
            for name, t in tables.items()]
    return spark.createDataFrame(rows, CATALOG_TYPE)


def field_table(catalog: DataFrame) -> DataFrame:
    """Flatten the nested catalog to one row per field; a missing description is ''."""
    flat = catalog.select("tabla", F.inline("campos"))
    return flat.withColumn("descripcion", F.coalesce("descripcion", F.lit("")))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(nombre, filas, nulos) for each column, all from one aggregate scan."""
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    entries = [F.struct(F.lit(c).alias("nombre"), F.col(c).cast("long").alias("nulos")) for c in columns]
    return row.select(F.col("__rows").cast("long").alias("filas"), F.inline(F.array(*entries)))


def check_catalog(fields: DataFrame, data: DataFrame, table: str) -> DataFrame:
    """Declared fields of ``table`` with their NULL counts and whether they comply.

    A field complies when it is optional or has no NULL; a declared field missing from
    the data gets NULL counts and does not comply.
    """
    declared = fields.filter(F.col("tabla") == table)
    present = [c for c in data.columns]
    counts = null_counts(data, present)
    out = declared.join(F.broadcast(counts), "nombre", "left")
    return out.withColumn("cumple", F.coalesce(~F.col("obligatorio") | (F.col("nulos") == 0), F.lit(False)))


def violations(data: DataFrame, table: str, declared: Table) -> DataFrame:
    """(tabla, campo, restriccion, violaciones, filas) of everything that the catalog declares of ``table``."""
    found = X.violations(data, {f.nombre: f.constraints() for f in declared.campos})
    return found.select(F.lit(table).alias("tabla"), "campo", "restriccion", "violaciones", "filas")


# ------------------------------------------------------------------ lineage / quality
def lineage_rows(spark: SparkSession, runinfo) -> DataFrame:
    """One row per stage output: stage, source and target (file stems), rows in and out."""
    rows = []
    for b in runinfo.bronze:
        rows.append(("bronze", b["origen"], b["destino"], b["filas"], b["filas"]))
    for s in runinfo.silver:
        rows.append(("silver", s["origen"], s["destino"], s["filas_entrada"], s["filas_validas"]))
    silver_rows = {s["destino"]: s["filas_validas"] for s in runinfo.silver}
    for g in runinfo.gold:
        src = g.get("origen", "")
        rows.append(("gold", src, g["destino"], silver_rows.get(src, None), g["filas"]))
    df = spark.createDataFrame(rows, "etapa string, origen string, destino string, "
                                     "filas_entrada long, filas_salida long")
    return df.select("etapa", file_stem("origen").alias("origen"), file_stem("destino").alias("destino"),
                     "filas_entrada", "filas_salida")


STAGE_TYPES = {
    "bronze": "struct<fuente:string,origen:string,destino:string,filas:bigint,columnas:bigint,"
              "nombres_columnas:array<string>,timestamp_ingesta:string>",
    "silver": "struct<origen:string,destino:string,filas_entrada:bigint,filas_validas:bigint,filas_descartadas:bigint,"
              "tasa_error_pct:double,timestamp_proceso:string,reporte_calidad:map<string,struct<"
              "total_invalidos:bigint,porcentaje:double,total_filas:bigint,filas_validas:bigint,filas_invalidas:bigint,"
              "tasa_error_pct:double>>>",
    "gold": "struct<tabla:string,origen:string,destino:string,filas:bigint,pregunta:string,timestamp_proceso:string>",
}


def stage_records(spark: SparkSession, runinfo) -> DataFrame:
    """One row: the records of the run's stages, as one array of structs per zone."""
    zones = ", ".join(f"{zone} array<{kind}>" for zone, kind in STAGE_TYPES.items())
    return spark.createDataFrame([{zone: getattr(runinfo, zone) for zone in STAGE_TYPES}], zones)


def lineage_document(spark: SparkSession, runinfo, pipeline: str, description: str = "", script: str = "") -> DataFrame:
    """One row: when the run began and ended, and its stage records under ``etapas``."""
    return stage_records(spark, runinfo).select(
        F.lit(pipeline).alias("pipeline"), F.lit(description).alias("descripcion"), F.lit(script).alias("script"),
        F.lit(runinfo.start).alias("ejecucion_inicio"), F.lit(runinfo.end).alias("ejecucion_fin"),
        F.struct(*STAGE_TYPES).alias("etapas"))


def quality_document(spark: SparkSession, runinfo, generated: str | None = None) -> DataFrame:
    """One row: per silver table, under ``fuentes``, its row counts, error rate and per-rule report."""
    each = F.transform("silver", lambda s: F.struct(
        F.regexp_extract(s["destino"], r"([^/]+?)(\.[^./]*)?$", 1),
        F.struct(*[s[c].alias(c) for c in ("filas_entrada", "filas_validas", "filas_descartadas", "tasa_error_pct")],
                 s["reporte_calidad"].alias("por_regla"))))
    return stage_records(spark, runinfo).select(
        F.lit(generated or runinfo.end).alias("generado"), F.map_from_entries(each).alias("fuentes"))
