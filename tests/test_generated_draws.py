"""The generators' queries take every draw from a SHA-256 digest of its own, in the code and in the SQL."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _u(i, salt):
    return (int(hashlib.sha256(f"{i}:{salt}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def _normal(i, salt):
    return math.sqrt(-2 * math.log(_u(i, salt + ".a"))) * math.cos(2 * math.pi * _u(i, salt + ".b"))


def _oracle(name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]


def _both(spark, name):
    return [[r.asDict() for r in E.queries()[name](spark, SF).collect()], _oracle(name)]


def test_generated_readings_take_a_digest_for_each_draw(spark):
    for rows in _both(spark, "generated_readings"):
        assert len(rows) == 5 * (len(_oracle("generated_events")) // 5) > 0
        for r in rows:
            i = r["i"]
            cold = -1.5 if 2 <= int(r["timestamp"][11:13]) <= 5 else 0.0
            want = {"temperatura_c": (16.8 + cold + 1.5 * _normal(i, "42:r:temp"), 2),
                    "humedad_pct": (3.0 + 17.0 * _u(i, "42:r:hum"), 1),
                    "velocidad_viento_ms": (abs(5.3 + 2.1 * _normal(i, "42:r:wind")), 2),
                    "presion_hpa": (745.0 + 2.5 * _normal(i, "42:r:pres"), 2),
                    "seeing_arcsec": (abs(0.64 + 0.25 * _normal(i, "42:r:see")), 3),
                    "transparencia": (0.65 + 0.35 * _u(i, "42:r:tra"), 3)}
            for column, (value, digits) in want.items():
                assert abs(r[column] - value) <= 0.5 * 10**-digits + 1e-9, (i, column)


def test_generated_records_take_a_digest_for_each_draw(spark):
    for rows in _both(spark, "generated_records"):
        assert len(rows) == len(_oracle("generated_events")) > 0
        for r in rows:
            i = r["i"]
            assert r["user_id"] == 1 + math.floor(_u(i, "42:t:user") * 4999)
            assert abs(r["value"] - (1000.0 + 100.0 * _normal(i, "42:t:value"))) <= 0.5e-6 + 1e-9
            assert r["category"] == "ABCDE"[math.floor(_u(i, "42:t:cat") * 5)]
            assert r["text"] == str(math.floor(_u(i, "42:t:text") * (1 << 20)))


def _score(i, k):
    return int(hashlib.sha256(f"{i}:42:e:pick{k}".encode()).hexdigest()[:15], 16), i


def _smallest(n, k):
    return {i for _, i in sorted(_score(i, k) for i in range(n))[:max(1, int(n * 0.10 / 8))]}


def _errors(rows):
    """How many rows hold each injected error."""
    return {"temperatura": sum(r["temperatura_c"] == -999 for r in rows), "humedad": sum(r["humedad_pct"] > 100 for r in rows),
            "sensor_nulo": sum(r["sensor_id"] is None for r in rows),
            "timestamp_futuro": sum(r["timestamp"].startswith("2027") for r in rows),
            "seeing": sum(r["seeing_arcsec"] < 0 for r in rows), "presion": sum(r["presion_hpa"] > 900 for r in rows),
            "transparencia": sum(r["transparencia"] > 1 for r in rows)}


def _wanted_errors():
    n = 5 * (len(_oracle("generated_events")) // 5)
    copied = _smallest(n, 8)
    kinds = ["temperatura", "humedad", "sensor_nulo", "timestamp_futuro", "seeing", "presion", "transparencia"]
    return n, {kind: len(hit := _smallest(n, k)) + len(hit & copied) for k, kind in enumerate(kinds, start=1)}


def test_injected_readings_choose_each_kind_by_a_digest_of_its_own(spark):
    n, want = _wanted_errors()
    hot = {r["i"]: r for r in _oracle("generated_readings")}
    sentinel = _smallest(n, 1)
    untouched = set(range(n)).difference(*(_smallest(n, k) for k in range(1, 9)))
    columns = ("sensor_id", "timestamp", "temperatura_c", "humedad_pct", "presion_hpa")
    kept = sorted(tuple(hot[i][c] for c in columns) for i in untouched)
    for rows in _both(spark, "injected_readings"):
        assert len(rows) == n + len(_smallest(n, 8)) and _errors(rows) == want
        found = {tuple(r[c] for c in columns) for r in rows}
        assert all(x in found for x in kept)
        bad = {(r["humedad_pct"], r["velocidad_viento_ms"]) for r in rows if r["temperatura_c"] == -999}
        alone = sentinel - _smallest(n, 2)
        assert {(hot[i]["humedad_pct"], hot[i]["velocidad_viento_ms"]) for i in alone} <= bad


def test_injection_counts_are_those_of_own_digests(spark):
    n, want = _wanted_errors()
    total = n + len(_smallest(n, 8))
    want["total"] = sum(want.values())
    for rows in _both(spark, "injection_counts"):
        assert {r["tipo"]: r["filas"] for r in rows} == want
        assert all(abs(r["porcentaje"] - 100 * r["filas"] / total) <= 0.05 + 1e-9 for r in rows)
