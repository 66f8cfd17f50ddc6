"""Rule engine: named error predicates, an any-error flag, filtering and the report.

A rule is either a boolean ``Column`` (TRUE = the row breaks the rule) or a
``Duplicated`` marker for "this key occurs more than once".  Semantics kept on purpose:

* Flags are three-valued.  ``any`` is a Kleene OR (``NULL OR FALSE`` is NULL), and
  ``keep_valid`` keeps only rows whose any-flag is FALSE, so a NULL flag drops the row
  although the report (which counts TRUE only) does not call it invalid.
* Duplicates flag every copy, and NULL keys compare equal to each other.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestone.functions.numeric import percent
from lakestone.operators.key_filter import FILTER_BITS, filter_words, with_possible

ANY_ERROR = "tiene_error"          # fixed value: name of the any-error flag column
SUMMARY_RULE = "__resumen__"       # fixed value: name of the summary entry of a report


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ----------------------------------------------------------------------------- predicates
def equals(c, value) -> Column:
    return _col(c) == F.lit(value)


def above(c, bound) -> Column:
    return _col(c) > F.lit(bound)


def below(c, bound) -> Column:
    return _col(c) < F.lit(bound)


def is_null(c) -> Column:
    return _col(c).isNull()


def not_in(c, values: Sequence) -> Column:
    """Outside a domain list.  A NULL value gives a NULL flag (unknown), not TRUE."""
    return ~_col(c).isin(list(values))


def outside(c, low, high) -> Column:
    return (_col(c) < F.lit(low)) | (_col(c) > F.lit(high))


def starts_with(c, prefix: str) -> Column:
    return _col(c).startswith(prefix)


@dataclass(frozen=True)
class Duplicated:
    """Rule: the key (one or more columns) occurs on more than one row."""
    keys: tuple[str, ...]
    method: str = "aggregate"


def duplicated(*keys: str, method: str = "aggregate") -> Duplicated:
    return Duplicated(tuple(keys), method)


# ------------------------------------------------------------------------------ duplicates
def flag_duplicates(df: DataFrame, keys: Sequence[str], name: str, method: str = "aggregate") -> DataFrame:
    """Add boolean ``name``: TRUE on every row whose key occurs more than once (see ``flag_all_duplicates``).

    ``digest`` (wide keys, e.g. a whole document) compares SHA-256 digests of the keys: see
    ``_flag_duplicates_by_digest``.
    """
    return flag_all_duplicates(df, {name: Duplicated(tuple(keys), method)})


def repeated_hashes(df: DataFrame, rules: Mapping[str, Duplicated], bits: int = FILTER_BITS) -> DataFrame:
    """(rule, word, mask): per rule a filter of ``bits`` bits, set for the key hashes that occur more than once.

    The keys of all rules go through one exchange, eight bytes a key, counted before it: a
    hot key is one row a task.  What follows holds repeated keys only.
    """
    tagged = [F.struct(F.lit(i).alias("rule"), F.xxhash64(F.lit(i), *r.keys).alias("hash")) for i, r in enumerate(rules.values())]
    repeated = (df.select(F.inline(F.array(*tagged))).groupBy("rule", "hash").agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") > 1))
    return filter_words(repeated, ["rule"], bits)


def flag_all_duplicates(df: DataFrame, rules: Mapping[str, Duplicated], bits: int = FILTER_BITS) -> DataFrame:
    """Add one boolean a rule: TRUE on every row whose key occurs more than once.

    Rows whose key hash is not in the filter of repeated hashes surely occur once: their
    flags are FALSE on the spot, and they are neither shuffled nor joined.  The others are
    counted and joined by their exact keys.  The filter has ``bits`` bits a rule whatever the
    table holds, so it may be sent to every task; it fills with repeated keys, not with
    keys, and where it is full every row is compared.
    """
    names = list(rules)
    filters = repeated_hashes(df, rules, bits)
    marked = df
    for i, rule in enumerate(rules.values()):
        hashed = F.xxhash64(F.lit(i), *[F.col(k) for k in rule.keys])
        marked = with_possible(marked, filters.where(F.col("rule") == i), hashed, f"__c{i}", bits)
    hits = [f"__c{i}" for i in range(len(names))]
    candidate = reduce(operator.or_, [F.col(c) for c in hits])
    once = marked.where(~candidate).drop(*hits).withColumns({n: F.lit(False) for n in names})
    exact = marked.where(candidate).drop(*hits)
    for n, rule in rules.items():
        exact = (_flag_duplicates_by_digest if rule.method == "digest" else _flag_duplicates)(exact, rule.keys, n)
    return once.unionByName(exact)


def _flag_duplicates(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Counts per key, pre-aggregated, joined back null-safely; AQE splits a hot key's join."""
    aliases = [f"__dup_k{i}" for i in range(len(keys))]
    repeated = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__dup_n"))
                .filter(F.col("__dup_n") > 1)
                .select(*[F.col(k).alias(a) for k, a in zip(keys, aliases)],
                        F.lit(True).alias(name)))
    cond = reduce(operator.and_, [df[k].eqNullSafe(repeated[a]) for k, a in zip(keys, aliases)])
    joined = df.join(repeated, cond, "left")
    return (joined.drop(*aliases)
            .withColumn(name, F.coalesce(F.col(name), F.lit(False))))


def _flag_duplicates_by_digest(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Duplicate flag for wide keys, such as whole documents, without moving them.

    Each key is replaced by its SHA-256 and its length before anything is shuffled, so the
    count and the join back carry a fixed number of bytes a row.  No two different texts
    with one SHA-256 are known, so equal digests are taken as equal texts.  NULL is equal
    to NULL and differs from the empty text.
    """
    marks = {f"__dg{i}": F.sha2(F.col(k).cast("string"), 256) for i, k in enumerate(keys)}
    marks |= {f"__ln{i}": F.octet_length(F.col(k).cast("string")) for i, k in enumerate(keys)}
    return _flag_duplicates(df.withColumns(marks), list(marks), name).drop(*marks)


# --------------------------------------------------------------------------- application
def any_flag(names: Sequence[str]) -> Column:
    """Kleene OR of the named flags (not ``greatest``: that would turn NULL into FALSE)."""
    return reduce(operator.or_, [F.col(n) for n in names])


def apply_rules(df: DataFrame, rules: Mapping[str, Column | Duplicated],
                any_name: str = ANY_ERROR) -> DataFrame:
    """One boolean column per rule (TRUE = error) plus the any-error column.

    The keys of all duplicate rules share one exchange; all column rules are one projection.
    """
    repeats = {n: r for n, r in rules.items() if isinstance(r, Duplicated)}
    out = flag_all_duplicates(df, repeats) if repeats else df
    column_rules = {n: r for n, r in rules.items() if not isinstance(r, Duplicated)}
    if column_rules:
        out = out.withColumns(column_rules)
    # Reorder so flags follow the rule registry order.
    base = [c for c in out.columns if c not in rules]
    out = out.select(*base, *[F.col(n) for n in rules])
    return out.withColumn(any_name, any_flag(list(rules)))


def keep_valid(flagged: DataFrame, any_name: str = ANY_ERROR) -> DataFrame:
    """Rows whose any-error flag is FALSE; TRUE and NULL are both dropped."""
    return flagged.filter(~F.col(any_name))


def drop_flags(df: DataFrame, rule_names: Sequence[str], any_name: str = ANY_ERROR) -> DataFrame:
    return df.drop(*rule_names, any_name)


# -------------------------------------------------------------------------------- report
def report_aggregates(rule_names: Sequence[str], any_name: str = ANY_ERROR) -> list[Column]:
    """Aggregates of a report, usable in ``agg`` or in ``DataFrame.observe``."""
    return ([F.count(F.lit(1)).alias("total_filas")]
            + [F.count_if(F.col(n)).alias(n) for n in rule_names]
            + [F.count_if(F.col(any_name)).alias("filas_invalidas"),
               F.count_if(~F.col(any_name)).alias("filas_conservadas")])


def rule_counts(flagged: DataFrame, rule_names: Sequence[str], any_name: str = ANY_ERROR) -> DataFrame:
    """One row: total rows, TRUE count per rule, invalid (TRUE) and kept (FALSE) counts.

    All rules are counted in one scan (a global partial aggregate), not one filter each.
    """
    return flagged.agg(*report_aggregates(rule_names, any_name))


def rule_counts_grouped(df: DataFrame, rules: Mapping[str, Column | Duplicated]) -> DataFrame:
    """The count row of ``rule_counts`` computed without joining duplicate flags back.

    With at most one duplicate rule, every count follows from one aggregate grouped by
    the duplicate key: a group with more than one row is entirely duplicate (TRUE for
    that rule, so its any-flag is TRUE); a single-row group's any-flag is the Kleene OR
    of the other rules.  The shuffle carries one partially aggregated row per key
    instead of the table, and a hot key collapses before it.  Falls back to flags plus
    a join for several duplicate rules.
    """
    dups = [(n, r) for n, r in rules.items() if isinstance(r, Duplicated)]
    if len(dups) > 1:
        return rule_counts(apply_rules(df, rules), list(rules))
    column_rules = {n: r for n, r in rules.items() if not isinstance(r, Duplicated)}
    others = any_flag(list(column_rules)) if column_rules else F.lit(False)
    flagged = df.withColumns(column_rules).withColumn("__other", others)
    if not dups:
        return rule_counts(flagged.withColumn(ANY_ERROR, F.col("__other")), list(rules))
    dup_name, dup = dups[0]
    per_key = flagged.groupBy(*dup.keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(n)).alias(n) for n in column_rules],
        F.count_if(F.col("__other")).alias("__other_true"),
        F.count_if(~F.col("__other")).alias("__other_false"))
    many = F.col("__n") > 1
    aggs = [F.sum("__n").alias("total_filas")]
    for n in rules:
        if n == dup_name:
            aggs.append(F.sum(F.when(many, F.col("__n")).otherwise(F.lit(0))).alias(n))
        else:
            aggs.append(F.sum(n).alias(n))
    aggs += [F.sum(F.when(many, F.col("__n")).otherwise(F.col("__other_true"))).alias("filas_invalidas"),
             F.sum(F.when(many, F.lit(0)).otherwise(F.col("__other_false"))).alias("filas_conservadas")]
    out = per_key.agg(*aggs)
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in out.columns])


def report_from_counts(counts: DataFrame, rule_names: Sequence[str]) -> DataFrame:
    """Long form of a count row: (regla, total_invalidos, porcentaje, total_filas).

    The last entry, ``__resumen__``, carries the rows with at least one TRUE flag.
    """
    entries = [F.struct(F.lit(n).alias("regla"), F.col(n).cast("long").alias("total_invalidos"))
               for n in rule_names]
    entries.append(F.struct(F.lit(SUMMARY_RULE).alias("regla"),
                            F.col("filas_invalidas").cast("long").alias("total_invalidos")))
    return (counts.select(F.col("total_filas").cast("long").alias("total_filas"),
                          F.inline(F.array(*entries)))
            .select("regla", "total_invalidos",
                    percent("total_invalidos", "total_filas").alias("porcentaje"),
                    "total_filas"))


def quality_report(flagged: DataFrame, rule_names: Sequence[str], any_name: str = ANY_ERROR) -> DataFrame:
    return report_from_counts(rule_counts(flagged, rule_names, any_name), rule_names)


def report_summary(counts: DataFrame) -> DataFrame:
    """One row: total_filas, filas_validas (total - invalid), filas_invalidas, tasa_error_pct."""
    return counts.select(
        F.col("total_filas").cast("long").alias("total_filas"),
        (F.col("total_filas") - F.col("filas_invalidas")).cast("long").alias("filas_validas"),
        F.col("filas_invalidas").cast("long").alias("filas_invalidas"),
        percent("filas_invalidas", "total_filas").alias("tasa_error_pct"),
    )
