"""Weighted multi-criteria scoring: one projection over one column per criterion."""

from __future__ import annotations

import operator
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_total(weights: Mapping[str, float]) -> Column:
    """Sum of score x weight; a NULL score adds nothing, so a row without scores has 0.0."""
    return reduce(operator.add, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w))
                                 for c, w in weights.items()])


def attach_labels(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Add the label columns of ``labels`` by key; keys without a label get NULL."""
    return df.join(labels, key, "left")


def ranked(df: DataFrame, score: str = "score_total", key: str | None = None) -> DataFrame:
    """Highest score first, key as tie-breaker."""
    cols = [F.col(score).desc_nulls_last()] + ([F.col(key).asc()] if key else [])
    return df.orderBy(*cols)


def weighted_ranking(wide: DataFrame, key: str, weights: Mapping[str, float],
                     labels: DataFrame | None = None) -> DataFrame:
    out = wide.withColumn("score_total", weighted_total(weights))
    if labels is not None:
        out = attach_labels(out, labels, key)
    return ranked(out, "score_total", key)
