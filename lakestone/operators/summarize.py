"""Declarative grouped summaries (the gold tables and the lake queries).

A summary is a list of ``Measure``s: output name, aggregate, input column, rounding.
``summarize`` turns it into one ``groupBy().agg()`` (partial aggregation before the
shuffle) and an ordering with NULLs last and the keys as tie-breakers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, FractionalType

from lakestone.functions.numeric import round_half_away

_AGGS = {
    "count": lambda c: F.count(F.lit(1)),
    "count_nonnull": lambda c: F.count(c),
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "stddev": F.stddev_samp,
    "count_distinct": lambda c: F.count_distinct(c),
}


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str
    column: str | None = None
    scale: int | None = None


def _aggregate(df: DataFrame, m: Measure) -> Column:
    col = F.col(m.column) if m.column else None
    value = _AGGS[m.agg](col)
    return rounded(value, m, df.schema[m.column].dataType if m.column else None).alias(m.name)


def rounded(value: Column, m: Measure, kind: DataType | None) -> Column:
    """``value`` as the measure returns it; ``kind`` is the input column's type."""
    if m.agg in ("count", "count_nonnull", "count_distinct"):
        return value.cast("long")
    # ROUND of an integer stays an integer: only round fractional results.
    if m.scale is not None and (m.agg in ("avg", "stddev") or isinstance(kind, FractionalType)):
        return round_half_away(value, m.scale)
    return value


def order_columns(order: Sequence[tuple[str, str]], keys: Sequence[str]) -> list[Column]:
    cols = [F.col(n).desc_nulls_last() if d == "desc" else F.col(n).asc_nulls_last() for n, d in order]
    named = {n for n, _ in order}
    return cols + [F.col(k).asc_nulls_last() for k in keys if k not in named]


def key_column(k) -> Column:
    """A group key: a column name, an ``(alias, sql_expression)`` pair, or a Column."""
    if isinstance(k, str):
        return F.col(k)
    if isinstance(k, tuple):
        return F.expr(k[1]).alias(k[0])
    return k


def summarize(df: DataFrame, keys: Sequence[Column | str], measures: Sequence[Measure],
              order: Sequence[tuple[str, str]] = ()) -> DataFrame:
    key_cols = [key_column(k) for k in keys]
    out = df.groupBy(*key_cols).agg(*[_aggregate(df, m) for m in measures])
    key_names = [c for c in out.columns if c not in {m.name for m in measures}]
    if order:
        out = out.orderBy(*order_columns(order, key_names))
    return out
