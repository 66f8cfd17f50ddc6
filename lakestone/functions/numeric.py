"""Numeric helpers: SQL-engine rounding, guarded percentages, derived measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(c, scale: int) -> Column:
    """ROUND(x, k) on doubles as columnar SQL engines do it: scale by 10^k, round half
    away from zero, unscale.

    Spark's ``round(x, k)`` rounds the shortest decimal text of ``x`` instead, so
    ``round(1.005, 2)`` is 1.01 there and 1.0 here.  Rounding the scaled value to 0
    decimals agrees with the scale-round-unscale rule.
    """
    c = _col(c)
    if scale == 0:
        return F.round(c, 0)
    factor = F.lit(10.0 ** scale)
    return F.round(c * factor, 0) / factor


def percent(part, total, scale: int = 2) -> Column:
    """``part / total * 100`` rounded, 0.0 when the total is 0 (zero guard everywhere)."""
    part, total = _col(part), _col(total)
    return (F.when(total > 0, round_half_away(part / total * F.lit(100.0), scale))
            .otherwise(F.lit(0.0)))


def pairs(n) -> Column:
    """Number of unordered pairs n(n-1)/2 in exact integer arithmetic.

    n(n-1) is never negative and always even, so a right shift by one is the integer
    division (and stays exact beyond 2^53, where a double would not).
    """
    n = _col(n).cast("long")
    return F.shiftright(n * (n - F.lit(1)), 1)


def per_unit(work, time) -> Column:
    """Throughput: work done per unit of time (NULL when time is 0)."""
    return _col(work) / F.nullif(_col(time), F.lit(0))


def mebibytes(elements, bytes_per_element: int = 8) -> Column:
    """Array size in MB (1024^2 bytes) for ``elements`` values of ``bytes_per_element``."""
    return _col(elements) * F.lit(float(bytes_per_element)) / F.lit(1024.0 ** 2)
