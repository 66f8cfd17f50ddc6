"""The compute-heavy per-row transform as native columns.

The score is a 50-term sum ``sin(x+i)^2 + cos(x*i+i)^2`` accumulated left to right,
and the tag is the first 8 hex digits of SHA-256(text || user id).  Both are plain
Spark expressions, so they run inside whole-stage code generation on every executor;
no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the transform: number of terms and tag length.
TERMS = 50
PREFIX_LEN = 8


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trig_score(x, terms: int = TERMS) -> Column:
    """Unrolled accumulation; same term order as a sequential loop starting at 0.0.

    Unrolling keeps the expression in generated code (a higher-order ``aggregate``
    over a ``sequence`` would be interpreted row by row).
    """
    x = _col(x).cast("double")
    acc = F.lit(0.0)
    for i in range(terms):
        s = F.sin(x + F.lit(float(i)))
        c = F.cos(x * F.lit(float(i)) + F.lit(float(i)))
        acc = acc + (s * s + c * c)
    return acc


def hash_prefix(text, user, length: int = PREFIX_LEN) -> Column:
    """First ``length`` hex digits of SHA-256 of ``text`` followed by ``user`` as text."""
    digest = F.sha2(F.concat(_col(text).cast("string"), _col(user).cast("string")), 256)
    return F.substring(digest, 1, length)
