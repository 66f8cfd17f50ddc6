"""Deterministic pseudo-random draws from a SHA-256 of (key, salt).

``rand(seed)`` depends on how rows fall into partitions, so a re-run on another
cluster (or after a lost executor) would give other values.  Hashing the row key
gives the same draw for the same row everywhere, and the same expression can be
written in any SQL engine that has SHA-256.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0
TWO_PI = 2.0 * math.pi


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slice_of(salt: str) -> tuple[str, int | None]:
    """``salt@k`` is the k-th slice of the digest of (key, salt): rows take several draws from one digest."""
    name, at, part = salt.partition("@")
    return name, int(part) if at else None


def _bits(key, salt: str, digits: int) -> Column:
    """The first ``digits`` hex digits of the salt's slice; a slice is as long as a multiple of eight digits needs."""
    name, part = slice_of(salt)
    digest = F.sha2(F.concat(_col(key).cast("string"), F.lit(f":{name}")), 256)
    return F.conv(F.substring(digest, 1 + (part or 0) * (-(-digits // 8) * 8), digits), 16, 10).cast("long")


def hash_score(key, salt: str) -> Column:
    """A non-negative 60-bit integer from the digest: a sort key for hash order (slices 0 to 3)."""
    return _bits(key, salt, 15)


def uniform01(key, salt: str) -> Column:
    """Uniform in (0, 1) from 32 bits of the digest, never exactly 0 or 1 (slices 0 to 7)."""
    return (_bits(key, salt, 8).cast("double") + F.lit(0.5)) / F.lit(TWO_POW_32)


def uniform(key, salt: str, low: float, high: float) -> Column:
    return F.lit(float(low)) + F.lit(float(high - low)) * uniform01(key, salt)


def std_normal(key, salt: str) -> Column:
    """Standard normal by Box-Muller from two independent uniforms of the same key: a slice and the next, or two digests."""
    name, part = slice_of(salt)
    first, second = (f"{name}.a", f"{name}.b") if part is None else (salt, f"{name}@{part + 1}")
    u1, u2 = uniform01(key, first), uniform01(key, second)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(TWO_PI) * u2)


def normal(key, salt: str, mean, std: float) -> Column:
    """``mean + std * z``; ``mean`` may be a number or a column."""
    m = mean if isinstance(mean, Column) else F.lit(float(mean))
    return m + F.lit(float(std)) * std_normal(key, salt)


def randint(key, salt: str, low: int, high: int) -> Column:
    """Integer uniform on [low, high], both ends included."""
    span = high - low + 1
    return (F.lit(low) + F.floor(uniform01(key, salt) * F.lit(float(span)))).cast("long")


def choice(key, salt: str, values: Sequence) -> Column:
    """One of ``values`` with equal probability."""
    idx = F.floor(uniform01(key, salt) * F.lit(float(len(values)))).cast("int")
    expr = None
    for i, v in enumerate(values):
        expr = (F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v)))
    return expr


def cumulative_thresholds(weights: Sequence[float]) -> list[float]:
    """Upper bounds of each choice but the last on the unit interval."""
    total = float(sum(weights))
    acc, out = 0.0, []
    for w in weights[:-1]:
        acc += w / total
        out.append(acc)
    return out


def weighted_choice(key, salt: str, values: Sequence, weights: Sequence[float]) -> Column:
    """One of ``values`` with the given probabilities (cumulative thresholds)."""
    u = uniform01(key, salt)
    expr = None
    for v, acc in zip(values[:-1], cumulative_thresholds(weights)):
        expr = F.when(u < F.lit(acc), F.lit(v)) if expr is None else expr.when(u < F.lit(acc), F.lit(v))
    last = F.lit(values[-1])
    return last if expr is None else expr.otherwise(last)
