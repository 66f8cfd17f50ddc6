"""DuckDB SQL text for the hash draws (same definitions as ``lakestone.functions.draws``)."""

from __future__ import annotations

import math

from lakestone.functions.draws import cumulative_thresholds

TWO_PI = 2.0 * math.pi


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _bits(key: str, salt: str, digits: int, width: int) -> str:
    name, _, part = salt.partition("@")
    return f"CAST(('0x' || substr(sha256(CAST({key} AS VARCHAR) || ':{name}'), {1 + int(part or 0) * width}, {digits})) AS BIGINT)"


def u01(key: str, salt: str) -> str:
    return f"(({_bits(key, salt, 8, 8)})::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


def score(key: str, salt: str) -> str:
    return _bits(key, salt, 15, 16)


def uniform(key: str, salt: str, lo: float, hi: float) -> str:
    return f"({dbl(lo)} + {dbl(hi - lo)} * {u01(key, salt)})"


def std_normal(key: str, salt: str) -> str:
    name, at, part = salt.partition("@")
    first, second = (salt, f"{name}@{int(part) + 1}") if at else (salt + ".a", salt + ".b")
    return f"(sqrt({dbl(-2.0)} * ln({u01(key, first)})) * cos({dbl(TWO_PI)} * {u01(key, second)}))"


def randint(key: str, salt: str, lo: int, hi: int) -> str:
    return f"CAST({lo} + floor({u01(key, salt)} * {dbl(hi - lo + 1)}) AS BIGINT)"


def pick(index_sql: str, values: list) -> str:
    whens = " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in enumerate(values))
    return f"(CASE {index_sql} {whens} END)"


def choice(key: str, salt: str, values: list) -> str:
    return pick(f"CAST(floor({u01(key, salt)} * {dbl(len(values))}) AS INTEGER)", values)


def weighted(key: str, salt: str, values: list, weights: list) -> str:
    u = u01(key, salt)
    whens = " ".join(f"WHEN {u} < {dbl(t)} THEN {lit(v)}"
                     for v, t in zip(values[:-1], cumulative_thresholds(weights)))
    return f"(CASE {whens} ELSE {lit(values[-1])} END)"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return dbl(v)
    return str(v)
