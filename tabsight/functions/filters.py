"""Slice predicates: filter specs to one conjunctive Spark predicate.

Comparison follows value equality without coercion between text and numbers:
``"5"`` never equals ``5.0``, a NULL cell differs from every non-NULL value.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from typing import Any, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.config import FilterSpec
from tabsight.functions.cells import col, kind_of, parse_number, text_of


def _as_number(value: Any) -> Column:
    if value is None or isinstance(value, bool):
        return F.lit(None).cast("double")
    if isinstance(value, (int, float)):
        return parse_number(F.lit(float(value)), "floating")
    return parse_number(F.lit(str(value)))


def _equals(c: Column, kind: str, value: Any) -> Column:
    if value is None:
        return c.isNull()
    if isinstance(value, str):
        return c.eqNullSafe(F.lit(value)) if kind == "string" else F.lit(False)
    if isinstance(value, (bool, int, float)):
        if kind in ("integral", "floating", "decimal"):
            return c.cast("double").eqNullSafe(F.lit(float(value)))
        if kind == "boolean" and value in (0, 1):
            return c.eqNullSafe(F.lit(bool(value)))
        return F.lit(False)
    if isinstance(value, (date, datetime)):
        return c.cast("timestamp").eqNullSafe(F.lit(value).cast("timestamp")) if kind == "temporal" else F.lit(False)
    return F.lit(False)


def predicate(df: DataFrame, spec: FilterSpec) -> Column:
    """Boolean column of one filter; never NULL."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    if spec.column in fields:
        c, kind = col(spec.column), kind_of(fields[spec.column])
    else:
        c, kind = F.lit(None).cast("string"), "string"

    op = spec.operation
    if op == "equals":
        return _equals(c, kind, spec.value)
    if op == "not_equals":
        return ~_equals(c, kind, spec.value)
    if op == "contains":
        if spec.value is None:
            return F.lit(False)
        text = F.lower(F.coalesce(text_of(c, kind), F.lit("None")))
        return text.contains(str(spec.value).lower())
    if op == "in":
        values = spec.value if isinstance(spec.value, (list, tuple, set)) else [spec.value]
        return reduce(lambda a, b: a | b, [_equals(c, kind, v) for v in values], F.lit(False))

    left = parse_number(c, kind)
    bound = _as_number(spec.value)
    tests = {
        "greater_than": lambda: left > bound,
        "greater_equal": lambda: left >= bound,
        "less_than": lambda: left < bound,
        "less_equal": lambda: left <= bound,
        "between": lambda: (left >= bound) & (left <= _as_number(spec.value_max)),
    }
    if op not in tests:
        raise ValueError(f"Unknown filter operation {op!r}.")
    return F.coalesce(tests[op](), F.lit(False))


def slice_rows(df: DataFrame, specs: Iterable[FilterSpec]) -> DataFrame:
    """Keep the rows that satisfy every filter; no filters keep all rows."""
    specs = list(specs)
    if not specs:
        return df
    return df.filter(reduce(lambda a, b: a & b, [predicate(df, s) for s in specs]))
