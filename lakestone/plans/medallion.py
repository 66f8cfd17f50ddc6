"""Bronze -> silver -> gold -> metadata, as DataFrame stages.

* Bronze reads a raw source with an explicit schema and writes it unchanged as Parquet.
* Silver flags every row with the rule registry, keeps rows whose any-error flag is
  FALSE, drops the flags, fixes the types and writes.  The report counts ride along
  the same job through ``DataFrame.observe`` (no second scan, no per-rule pass).
* Gold tables are grouped summaries of silver tables.
* Metadata (stage records, lineage, quality report) is a few small rows per stage.

Zones are folders (or s3a:// prefixes) under one base URI.
"""

from __future__ import annotations

import datetime as _dt
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakestone.functions.text import ISO_SECONDS
from lakestone.operators import rules as R
from lakestone.operators import states
from lakestone.operators.summarize import summarize
from lakestone.sources.readers import read_csv_tokens, read_ndjson
from lakestone.sources.sinks import write_parquet


def cast_columns(df: DataFrame, casts: Mapping[str, object]) -> DataFrame:
    """Strict casts (ANSI: bad input fails).  ``timestamp_ntz`` parses ISO-seconds text."""
    out = {}
    for name, typ in casts.items():
        t = typ if isinstance(typ, str) else typ.simpleString()
        if t == "timestamp_ntz":
            out[name] = F.to_timestamp_ntz(F.col(name), F.lit(ISO_SECONDS))
        else:
            out[name] = F.col(name).cast(t)
    return df.withColumns(out)


def silver_table(bronze: DataFrame, rules: Mapping, casts: Mapping[str, object],
                 any_name: str = R.ANY_ERROR) -> DataFrame:
    """Flag, keep rows with no error (NULL any-flag is dropped), drop flags, fix types."""
    flagged = R.apply_rules(bronze, rules, any_name)
    kept = R.drop_flags(R.keep_valid(flagged, any_name), list(rules), any_name)
    return cast_columns(kept, casts)


def _now() -> str:
    return _dt.datetime.now().isoformat(timespec="seconds")


# ----------------------------------------------------------------------------- specs
@dataclass
class SourceSpec:
    """One raw source and how it becomes a silver table."""
    name: str                     # raw file name, e.g. "lecturas_sensores.csv"
    path: str
    fmt: str                      # "csv", "ndjson" or "parquet"
    schema: StructType | None
    bronze: str                   # bronze table name
    silver: str                   # silver table name
    rules: Mapping
    casts: Mapping[str, object]
    prepare: object = None        # optional DataFrame -> DataFrame applied after the read


@dataclass
class GoldSpec:
    name: str
    source: str                   # silver table name
    spec: tuple                   # (keys, measures, order) for ``summarize``
    question: str = ""


@dataclass
class PipelineRun:
    start: str
    end: str = ""
    bronze: list = field(default_factory=list)
    silver: list = field(default_factory=list)
    gold: list = field(default_factory=list)
    paths: dict = field(default_factory=dict)


def zone(base_uri: str, name: str) -> str:
    return f"{base_uri.rstrip('/')}/{name}"


# ----------------------------------------------------------------------------- stages
def read_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    if spec.fmt == "csv":
        df = read_csv_tokens(spark, spec.path, spec.schema)
    elif spec.fmt == "ndjson":
        df = read_ndjson(spark, spec.path, spec.schema)
    else:
        df = spark.read.parquet(spec.path)
    return spec.prepare(df) if callable(spec.prepare) else df


def ingest(spark: SparkSession, spec: SourceSpec, base_uri: str) -> dict:
    """Raw source -> bronze Parquet, rows counted by the write itself."""
    target = zone(base_uri, f"bronze/{spec.bronze}.parquet")
    df = read_source(spark, spec)
    obs = Observation(f"bronze_{spec.bronze}")
    write_parquet(df.observe(obs, F.count(F.lit(1)).alias("rows")), target)
    return {"fuente": spec.name, "origen": spec.path, "destino": target,
            "filas": int(obs.get["rows"]), "columnas": len(df.columns),
            "nombres_columnas": list(df.columns), "timestamp_ingesta": _now()}


def refine(spark: SparkSession, spec: SourceSpec, base_uri: str) -> dict:
    """Bronze -> silver in one job; the quality report comes from observed counts."""
    source = zone(base_uri, f"bronze/{spec.bronze}.parquet")
    target = zone(base_uri, f"silver/{spec.silver}.parquet")
    bronze = spark.read.parquet(source)
    names = list(spec.rules)
    flagged = R.apply_rules(bronze, spec.rules)
    obs = Observation(f"silver_{spec.silver}")
    observed = flagged.observe(obs, *R.report_aggregates(names))
    silver = cast_columns(R.drop_flags(R.keep_valid(observed), names), spec.casts)
    write_parquet(silver, target)
    m = obs.get
    total, invalid, kept = int(m["total_filas"]), int(m["filas_invalidas"]), int(m["filas_conservadas"])
    report = {n: {"total_invalidos": int(m[n]), "porcentaje": _pct(int(m[n]), total)} for n in names}
    report[R.SUMMARY_RULE] = {"total_filas": total, "filas_validas": total - invalid,
                              "filas_invalidas": invalid, "tasa_error_pct": _pct(invalid, total)}
    return {"origen": source, "destino": target, "filas_entrada": total, "filas_validas": kept,
            "filas_descartadas": total - kept, "tasa_error_pct": _pct(total - kept, total),
            "timestamp_proceso": _now(), "reporte_calidad": report}


def _pct(n: int, total: int) -> float:
    """Percent rounded half away from zero at 2 decimals, 0.0 for an empty table."""
    if total <= 0:
        return 0.0
    x = n / total * 100 * 100
    r = math.floor(x)
    if x - r >= 0.5:  # half away from zero (x is never negative here)
        r += 1
    return r / 100


def build_gold(spark: SparkSession, spec: GoldSpec, base_uri: str) -> dict:
    source = zone(base_uri, f"silver/{spec.source}.parquet")
    target = zone(base_uri, f"gold/{spec.name}.parquet")
    table = summarize(spark.read.parquet(source), *spec.spec)
    obs = Observation(f"gold_{spec.name}")
    write_parquet(table.observe(obs, F.count(F.lit(1)).alias("rows")), target)
    return {"tabla": spec.name, "origen": source, "destino": target, "filas": int(obs.get["rows"]),
            "pregunta": spec.question, "timestamp_proceso": _now()}


def refresh_gold(spark: SparkSession, spec: GoldSpec, base_uri: str, arrived: DataFrame, batch: Column) -> dict:
    """Add the silver rows that ``arrived`` (all rows of their batches) to a gold table, from stored states.

    Neither the silver rows of other batches nor the old gold table are read.
    """
    target = zone(base_uri, f"gold/{spec.name}.parquet")
    folder = zone(base_uri, f"gold_states/{spec.name}")
    states.add_batches(arrived, spec.spec, folder, batch)
    obs = Observation(f"gold_{spec.name}")
    write_parquet(states.from_batches(spark, spec.spec, folder).observe(obs, F.count(F.lit(1)).alias("rows")), target)
    return {"tabla": spec.name, "origen": folder, "destino": target, "filas": int(obs.get["rows"]),
            "pregunta": spec.question, "timestamp_proceso": _now()}


def side_by_side(jobs: Sequence) -> list:
    """Results of independent driver-side jobs, run from as many threads, in order."""
    if not jobs:
        return []
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def run(spark: SparkSession, sources: Sequence[SourceSpec], golds: Sequence[GoldSpec],
        base_uri: str) -> PipelineRun:
    """The whole pipeline; returns the stage records (small dicts of counts and paths)."""
    runinfo = PipelineRun(start=_now())
    # Sources don't depend on each other, nor do gold tables: their jobs share the cluster.
    stages = side_by_side([lambda s=s: (ingest(spark, s, base_uri), refine(spark, s, base_uri)) for s in sources])
    runinfo.bronze, runinfo.silver = [b for b, _ in stages], [s for _, s in stages]
    runinfo.gold = side_by_side([lambda g=g: build_gold(spark, g, base_uri) for g in golds])
    runinfo.end = _now()
    runinfo.paths = {"base": base_uri}
    return runinfo


def run_summary(spark: SparkSession, runinfo: PipelineRun) -> DataFrame:
    """One row of counts per run (the end-of-run printout as a table)."""
    row = (sum(b["filas"] for b in runinfo.bronze),
           sum(s["filas_validas"] for s in runinfo.silver),
           sum(s["filas_descartadas"] for s in runinfo.silver),
           sum(s["reporte_calidad"][R.SUMMARY_RULE]["filas_invalidas"] for s in runinfo.silver),
           len(runinfo.gold),
           sum(g["filas"] for g in runinfo.gold))
    return spark.createDataFrame([row], "bronze_rows long, silver_rows long, dropped_rows long, "
                                        "invalid_rows long, gold_tables long, gold_rows long")


__all__ = ["cast_columns", "silver_table", "SourceSpec", "GoldSpec", "PipelineRun", "ingest",
           "refine", "build_gold", "refresh_gold", "run", "run_summary", "side_by_side", "zone"]
