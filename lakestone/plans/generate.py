"""Synthetic observatory data with injected errors, as projections over an index column.

Every value is a hash draw keyed by the row index (see ``lakestone.functions.draws``),
so the same index gives the same row on any cluster and in any partitioning.  The
index can be ``spark.range(n)`` or the id column of an existing table.

Error injection picks exactly ``n_err`` rows per error type by hash order
(``lakestone.operators.sampling``); types may overlap, as in the source generator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestone.functions.draws import (choice, hash_score, randint, std_normal, uniform,
                                       weighted_choice)
from lakestone.functions.numeric import round_half_away as rh
from lakestone.functions.text import ISO_SECONDS
from lakestone.operators.sampling import at_or_below, rank_cutoffs, rank_in_sample
from lakestone.plans import observatory as obs

READING_COLUMNS = ["sensor_id", "timestamp", "ubicacion", "temperatura_c", "humedad_pct",
                   "velocidad_viento_ms", "presion_hpa", "seeing_arcsec", "transparencia"]
EVENT_COLUMNS = ["obs_id", "sensor_id", "timestamp", "objeto_observado", "magnitud", "ascension_recta",
                 "declinacion", "duracion_min", "instrumento", "estado"]


#: Salts of a reading's draws: a digest of its own for each draw (two for a normal), or slices of two digests a row.
READING_SALTS = {"temperatura_c": "temp", "humedad_pct": "hum", "velocidad_viento_ms": "wind", "presion_hpa": "pres",
                 "seeing_arcsec": "see", "transparencia": "tra"}
SLICED_READING_SALTS = {"temperatura_c": "a@0", "humedad_pct": "a@2", "velocidad_viento_ms": "a@3", "presion_hpa": "b@0",
                        "seeing_arcsec": "b@2", "transparencia": "a@5"}


def _pick(index: F.Column, values: list) -> F.Column:
    expr = None
    for k, v in enumerate(values):
        expr = F.when(index == k, F.lit(v)) if expr is None else expr.when(index == k, F.lit(v))
    return expr


# ------------------------------------------------------------------------------ readings
def readings_from_index(idx: DataFrame, n_per_sensor: int, seed: int = 42, i: str = "i",
                        own_digests: bool = False) -> DataFrame:
    """Base readings: sensor ``i div n_per_sensor``, reading ``i mod n_per_sensor``.

    Rows whose index is outside [0, 5 * n_per_sensor) are not readings and are skipped.
    ``own_digests`` takes every draw from a digest of its own.
    """
    n_sensors = len(obs.SENSORS)
    key = F.col(i)
    sensor = F.expr(f"`{i}` div {n_per_sensor}")
    step = F.expr(f"`{i}` % {n_per_sensor}")
    ts = F.timestamp_add("MINUTE", step * F.lit(obs.READINGS_STEP_MINUTES),
                         F.lit(obs.READINGS_START).cast("timestamp_ntz"))
    hour = F.hour(ts)
    adj = F.when(hour.between(*obs.COLD_HOURS), F.lit(obs.COLD_BY)).otherwise(F.lit(0.0))
    salts = {c: f"{seed}:r:{x}" for c, x in (READING_SALTS if own_digests else SLICED_READING_SALTS).items()}
    return (idx.filter((key >= 0) & (key < F.lit(n_sensors * n_per_sensor)))
            .select(
                key.alias(i),
                _pick(sensor, obs.SENSORS).alias("sensor_id"),
                F.date_format(ts, ISO_SECONDS).alias("timestamp"),
                _pick(sensor, list(obs.SENSOR_PLACES.values())).alias("ubicacion"),
                rh((F.lit(obs.TEMPERATURE[0]) + adj) + F.lit(obs.TEMPERATURE[1]) * std_normal(key, salts["temperatura_c"]), 2).alias("temperatura_c"),
                rh(uniform(key, salts["humedad_pct"], *obs.HUMIDITY), 1).alias("humedad_pct"),
                rh(F.abs(F.lit(obs.WIND[0]) + F.lit(obs.WIND[1]) * std_normal(key, salts["velocidad_viento_ms"])), 2).alias("velocidad_viento_ms"),
                rh(F.lit(obs.PRESSURE[0]) + F.lit(obs.PRESSURE[1]) * std_normal(key, salts["presion_hpa"]), 2).alias("presion_hpa"),
                rh(F.abs(F.lit(obs.SEEING[0]) + F.lit(obs.SEEING[1]) * std_normal(key, salts["seeing_arcsec"])), 3).alias("seeing_arcsec"),
                rh(uniform(key, salts["transparencia"], *obs.TRANSPARENCY), 3).alias("transparencia")))


def pick_salt(salt: str, k: int, own_digests: bool = False) -> str:
    """Salt of the scores that choose the rows of error type ``k`` (from 1): four types share a digest unless each has its own."""
    return f"{salt}:pick{k}" if own_digests else f"{salt}:pick{(k - 1) // 4}@{(k - 1) % 4}"


def error_count(n_rows: int, rate: float, kinds: int) -> int:
    """Rows per error type: max(1, int(n * rate / kinds))."""
    return max(1, int(n_rows * rate / kinds))


def future_text(key: F.Column, salt: str, hour: F.Column | None = None, minute: F.Column | None = None) -> F.Column:
    """A ``2027-MM-DDTHH:MM:00`` timestamp text with drawn month and day."""
    month = randint(key, f"{salt}:m", 1, 12)
    day = randint(key, f"{salt}:d", 1, 28)
    hh = hour if hour is not None else randint(key, f"{salt}:h", 0, 23)
    mm = minute if minute is not None else randint(key, f"{salt}:n", 0, 59)
    return F.format_string(obs.FUTURE_PREFIX + "-%02d-%02dT%02d:%02d:00", month, day, hh, mm)


def inject_reading_errors(base: DataFrame, n_err: int, seed: int = 42, i: str = "i",
                          own_digests: bool = False) -> DataFrame:
    """Seven error types on ``n_err`` hash-chosen rows each, then ``n_err`` exact copies.

    Membership depends only on the row index, so all eight samples are found together.
    """
    key = F.col(i)
    s = f"{seed}:e"
    replacements = [
        ("temperatura_c", lambda: F.lit(obs.TEMPERATURE_SENTINEL)),
        ("humedad_pct", lambda: rh(uniform(key, f"{s}:v2", *obs.BAD_HUMIDITY), 1)),
        ("sensor_id", lambda: F.lit(None).cast("string")),
        ("timestamp", lambda: future_text(key, f"{s}:v4")),
        ("seeing_arcsec", lambda: rh(uniform(key, f"{s}:v5", *obs.BAD_SEEING), 3)),
        ("presion_hpa", lambda: rh(uniform(key, f"{s}:v6", *obs.BAD_PRESSURE), 2)),
        ("transparencia", lambda: rh(uniform(key, f"{s}:v7", *obs.BAD_TRANSPARENCY), 3)),
    ]
    score = {k: hash_score(key, pick_salt(s, k, own_digests)) for k in range(1, 9)}
    # The searches need the index only.
    ids = base.select(i)
    cuts = rank_cutoffs({k: (ids, score[k], i) for k in score}, n_err)
    out = base
    for k, (column, value) in enumerate(replacements, start=1):
        hit = at_or_below(score[k], key, cuts[k])
        out = out.withColumn(column, F.when(hit, value()).otherwise(F.col(column)))
    # Exact copies of n_err rows (taken after the injections), appended.
    return out.unionByName(out.filter(at_or_below(score[8], key, cuts[8])))


def generate_readings(spark: SparkSession, n_total: int, error_rate: float = 0.10, seed: int = 42) -> DataFrame:
    n_per_sensor = n_total // len(obs.SENSORS)
    idx = spark.range(n_per_sensor * len(obs.SENSORS)).withColumnRenamed("id", "i")
    base = readings_from_index(idx, n_per_sensor, seed)
    n_rows = n_per_sensor * len(obs.SENSORS)
    n_err = error_count(n_rows, error_rate, 8)
    return inject_reading_errors(base, n_err, seed).select(*READING_COLUMNS)


# -------------------------------------------------------------------------------- events
def events_from_index(idx: DataFrame, seed: int = 42, i: str = "i") -> DataFrame:
    key = F.col(i)
    s = f"{seed}:o"
    offset_h = uniform(key, f"{s}:a@0", 0.0, 10.0) + randint(key, f"{s}:a@1", 0, 6) * F.lit(24)
    ts = F.timestamp_add("SECOND", F.floor(offset_h * F.lit(3600.0)).cast("long"),
                         F.lit(obs.EVENTS_START).cast("timestamp_ntz"))
    return idx.select(
        key.alias(i),
        F.format_string("OBS-2024-%04d", key + F.lit(1)).alias("obs_id"),
        choice(key, f"{s}:a@2", obs.SENSORS).alias("sensor_id"),
        F.date_format(ts, ISO_SECONDS).alias("timestamp"),
        choice(key, f"{s}:a@3", obs.CELESTIAL_OBJECTS).alias("objeto_observado"),
        rh(uniform(key, f"{s}:a@4", *obs.MAGNITUDE), 2).alias("magnitud"),
        rh(uniform(key, f"{s}:a@5", *obs.RIGHT_ASCENSION), 4).alias("ascension_recta"),
        rh(uniform(key, f"{s}:a@6", *obs.DECLINATION), 4).alias("declinacion"),
        randint(key, f"{s}:a@7", *obs.DURATION_MIN).alias("duracion_min"),
        choice(key, f"{s}:b@0", obs.VALID_INSTRUMENTS).alias("instrumento"),
        weighted_choice(key, f"{s}:b@1", obs.STATES, obs.STATE_WEIGHTS).alias("estado"))


def inject_event_errors(base: DataFrame, n_rows: int, n_err: int, seed: int = 42, i: str = "i") -> DataFrame:
    """Bad instrument, bad declination, 2027 date, reused id on appended copies, NULL sensor."""
    key = F.col(i)
    s = f"{seed}:x"
    edits = [
        ("instrumento", lambda: choice(key, f"{s}:v1", obs.INVALID_INSTRUMENTS)),
        ("declinacion", lambda: rh(uniform(key, f"{s}:v2", *obs.BAD_DECLINATION), 4)),
        ("timestamp", lambda: future_text(key, f"{s}:v3", F.lit(21), F.lit(0))),
    ]
    n_copies = min(n_err, n_rows)
    score = {k: hash_score(key, pick_salt(s, k)) for k in range(1, 6)}
    # Keys of the grown table: the base rows and the copies, which take n_rows + rank.
    grown = base.select(i).unionByName(
        base.sparkSession.range(n_rows, n_rows + n_copies).withColumnRenamed("id", i))
    ids = base.select(i)
    parts = {k: (ids, score[k], i) for k in range(1, 5)}
    parts[5] = (grown, score[5], i)
    cuts = rank_cutoffs(parts, n_err)
    out = base
    for k, (column, value) in enumerate(edits, start=1):
        out = out.withColumn(column, F.when(at_or_below(score[k], key, cuts[k]), value()).otherwise(F.col(column)))
    # The r-th copy (in hash order of the chosen rows) takes the id of event r + 1.
    place = rank_in_sample(ids.withColumn("__s4", score[4]), "__s4", i, cuts[4], n_copies, "__r")
    copies = (out.join(place, i)
              .withColumn("obs_id", F.format_string("OBS-2024-%04d", F.col("__r") + F.lit(1)))
              .withColumn(i, F.lit(n_rows) + F.col("__r"))
              .drop("__r"))
    out = out.unionByName(copies)
    # NULL sensor on n_err rows of the grown table (copies included).
    return out.withColumn("sensor_id", F.when(at_or_below(score[5], key, cuts[5]), F.lit(None).cast("string"))
                          .otherwise(F.col("sensor_id")))


def generate_events(spark: SparkSession, n_total: int, error_rate: float = 0.10, seed: int = 42) -> DataFrame:
    idx = spark.range(n_total).withColumnRenamed("id", "i")
    n_err = error_count(n_total, error_rate, 5)
    return inject_event_errors(events_from_index(idx, seed), n_total, n_err, seed).select(*EVENT_COLUMNS)


# --------------------------------------------------------------------------- transform input
def records_from_index(idx: DataFrame, seed: int = 42, i: str = "i") -> DataFrame:
    """Input of the heavy transform: user, value ~ N(1000, 100), category A-E, text, time."""
    key = F.col(i)
    s = f"{seed}:t"
    return idx.select(
        key.alias(i),
        randint(key, f"{s}:user", 1, 4999).alias("user_id"),
        (std_normal(key, f"{s}:value") * F.lit(100.0) + F.lit(1000.0)).alias("value"),
        choice(key, f"{s}:cat", list("ABCDE")).alias("category"),
        randint(key, f"{s}:text", 0, (1 << 20) - 1).cast("string").alias("text"),
        F.timestamp_add("SECOND", key, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).alias("timestamp"))


def generate_records(spark: SparkSession, n: int = 500_000, seed: int = 42) -> DataFrame:
    return records_from_index(spark.range(n).withColumnRenamed("id", "i"), seed).drop("i")


# ------------------------------------------------------------------------------- summary
def injected_counts(readings: DataFrame, future_prefix: str = obs.FUTURE_PREFIX) -> DataFrame:
    """Hits per error type with lenient numeric parsing, a total and its percent.

    The total adds hits, so a row with two errors counts twice (as in the source).
    """
    num = lambda c: F.col(c).cast("string").try_cast("double")
    counts = readings.agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count_if(num("temperatura_c") == -999).alias("temperatura"),
        F.count_if(num("humedad_pct") > 100).alias("humedad"),
        F.count_if(F.col("sensor_id").isNull()).alias("sensor_nulo"),
        F.count_if(F.col("timestamp").startswith(future_prefix)).alias("timestamp_futuro"),
        F.count_if(num("seeing_arcsec") < 0).alias("seeing"),
        F.count_if(num("presion_hpa") > 900).alias("presion"),
        F.count_if(num("transparencia") > 1).alias("transparencia"))
    kinds = ["temperatura", "humedad", "sensor_nulo", "timestamp_futuro", "seeing", "presion", "transparencia"]
    entries = [F.struct(F.lit(k).alias("tipo"), F.col(k).cast("long").alias("filas")) for k in kinds]
    entries.append(F.struct(F.lit("total").alias("tipo"),
                            sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])).cast("long").alias("filas")))
    long = counts.select(F.col("__rows").cast("long").alias("__rows"), F.inline(F.array(*entries)))
    return long.select("tipo", "filas",
                       F.when(F.col("__rows") > 0, rh(F.col("filas") / F.col("__rows") * F.lit(100.0), 1))
                       .otherwise(F.lit(0.0)).alias("porcentaje"))
