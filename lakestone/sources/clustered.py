"""Parquet clustered by several columns at once: their bits are interleaved, so a filter on any of them skips row groups.

Sorting by (a, b) keeps rows of one a together, but spreads those of one b over all files.
Here each column's value becomes its place among ``2 ** bits`` quantiles, and a row's
position is these places with their bits interleaved: neighbours in the order are
neighbours in every column.  Quantiles come from one aggregate and are the only numbers
that reach the driver.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StringType, TimestampNTZType, TimestampType


def _number(name: str, kind: DataType, skip: int = 0) -> Column:
    """The column as a number in its own order; of texts seven bytes after the first ``skip`` count."""
    c = F.col(f"`{name}`")
    if isinstance(kind, StringType):
        part = F.substring(F.encode(c, "UTF-8"), skip + 1, 7)
        return F.conv(F.rpad(F.hex(part), 14, "0"), 16, 10).cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, NumericType):
        return c.cast("double")
    raise TypeError(f"can't cluster by {name}: {kind.simpleString()}")


def _common_prefix(low: str | None, high: str | None) -> int:
    """Bytes that all texts between the two begin with."""
    return len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))


def position(df: DataFrame, columns: Sequence[str], bits: int = 6) -> Column:
    """A row's place on the curve through all ``columns``; NULLs stand before all values."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = [c for c in columns if isinstance(kinds[c], StringType)]
    skip = dict.fromkeys(columns, 0)
    if texts:
        ends = df.agg(*[x for i, c in enumerate(texts) for x in (F.min(f"`{c}`").alias(f"a{i}"), F.max(f"`{c}`").alias(f"z{i}"))]).first()
        skip |= {c: _common_prefix(ends[f"a{i}"], ends[f"z{i}"]) for i, c in enumerate(texts)}
    numbers = [_number(c, kinds[c], skip[c]) for c in columns]
    cells = 1 << bits
    cuts = df.agg(*[F.percentile_approx(n, [k / cells for k in range(1, cells)], 100 * cells).alias(f"q{i}")
                    for i, n in enumerate(numbers)]).first()
    place = F.lit(0).cast("long")
    for i, n in enumerate(numbers):
        bounds = sorted(set(cuts[f"q{i}"] or []))
        if not bounds:
            continue
        # Cells between equal quantiles are empty: distinct bounds are spread over all of them.
        cell = sum((F.when(n >= float(b), 1).otherwise(0) for b in bounds), F.lit(0))
        spread = F.floor(cell * ((cells - 1) / len(bounds))).cast("long")
        for j in range(bits):
            bit = F.shiftright(spread, j).bitwiseAND(F.lit(1).cast("long"))
            place = place + bit * (1 << (j * len(columns) + len(columns) - 1 - i))
    return place


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int | None = None, bits: int = 6,
                    row_group_bytes: int | None = None) -> str:
    """Replace the Parquet table at ``path`` by ``df``, clustered by ``columns``.

    Files are stretches of the curve, dealt by Spark's range partitioning (``files`` of them, or as
    the session's shuffles go); within a file rows stand in the curve's order.
    """
    own = "__place"
    keyed = df.withColumn(own, position(df, columns, bits))
    order = [own, *columns]  # the columns split a place that very many rows share
    dealt = keyed.repartitionByRange(files, *order) if files else keyed.repartitionByRange(*order)
    writer = dealt.sortWithinPartitions(*order).drop(own).write.mode("overwrite")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    return path
