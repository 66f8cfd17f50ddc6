"""Typed field constraints, compiled into the rule engine: all of a table's are counted in one aggregate.

A constraint says what a value must be; its compiled form is TRUE where a row breaks it.
Only ``required`` looks at NULL: to every other constraint a NULL is no violation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakestone.operators import rules as R

#: Declared type names and the types their values must parse as.
TYPES = {"string": "string", "datetime": "timestamp_ntz", "float64": "double", "int32": "int"}


@dataclass(frozen=True)
class Constraint:
    kind: str
    args: Mapping[str, object] = field(default_factory=dict)


def required() -> Constraint:
    return Constraint("required")


def typed(name: str) -> Constraint:
    """Parses as the declared type."""
    return Constraint("type", {"name": name})


def between(low: float | None = None, high: float | None = None, above: bool = False) -> Constraint:
    """At least ``low`` (more than it with ``above``) and at most ``high``; a value that is no number is not judged."""
    return Constraint("range", {"low": low, "high": high, "above": above})


def one_of(values: Sequence[str]) -> Constraint:
    return Constraint("domain", {"values": tuple(values)})


def matches(pattern: str) -> Constraint:
    """The whole text matches the pattern."""
    return Constraint("format", {"pattern": pattern})


def before(limit: str) -> Constraint:
    """An instant before ``limit``; a value that is no instant is not judged."""
    return Constraint("past", {"limit": limit})


def unique() -> Constraint:
    """No other row has the value; every copy is a violation."""
    return Constraint("unique")


def broken(column: str, c: Constraint) -> Column | R.Duplicated:
    """TRUE where a row breaks the constraint, never NULL (or the duplicate rule that says so)."""
    value, a = F.col(column), c.args
    text = value.cast("string")
    if c.kind == "unique":
        return R.duplicated(column)
    if c.kind == "required":
        return value.isNull()
    if c.kind == "type":
        found = value.isNotNull() & text.try_cast(TYPES[a["name"]]).isNull()
    elif c.kind == "range":
        number = text.try_cast("double")
        low = F.lit(False) if a["low"] is None else number <= a["low"] if a["above"] else number < a["low"]
        found = low | (F.lit(False) if a["high"] is None else number > a["high"])
    elif c.kind == "domain":
        found = ~value.isin(list(a["values"]))
    elif c.kind == "format":
        found = ~text.rlike(f"^(?:{a['pattern']})$")
    else:
        found = text.try_cast("timestamp_ntz") >= F.lit(a["limit"]).cast("timestamp_ntz")
    return F.coalesce(found, F.lit(False))


def violations(df: DataFrame, declared: Mapping[str, Sequence[Constraint]]) -> DataFrame:
    """(campo, restriccion, violaciones, filas): one row for each declared constraint.

    Every constraint is a rule of one report, so the table is read once, and a unique field
    adds one exchange of its keys.  A declared field that the data lacks breaks what is
    required of it in every row, and nothing else.
    """
    absent = {c: F.lit(None).cast("string") for c in declared if c not in df.columns}
    data = df.select(*[absent[c].alias(c) if c in absent else F.col(c) for c in declared])
    rules = {f"{c}__{x.kind}": broken(c, x) for c, xs in declared.items() for x in xs if not (c in absent and x.kind == "unique")}
    counts = R.rule_counts_grouped(data, rules)
    entries = [F.struct(F.lit(c).alias("campo"), F.lit(x.kind).alias("restriccion"),
                        (F.col(n) if (n := f"{c}__{x.kind}") in rules else F.lit(0)).cast("long").alias("violaciones"))
               for c, xs in declared.items() for x in xs]
    return counts.select(F.col("total_filas").cast("long").alias("filas"), F.inline(F.array(*entries)))
