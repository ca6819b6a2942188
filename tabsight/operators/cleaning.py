"""Cleaning: standardize cells, fill or drop missing ones, log every change."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tabsight.config import BOOLEAN, CATEGORICAL, DATE, NUMERIC, ROW, STRATEGIES, TEXT, Config
from tabsight.functions import cells as C
from tabsight.operators.fills import BUCKET_ROWS, fill_columns
from tabsight.operators.order_stats import MEDIAN, SMALL_GROUP, column_order_statistics, upper_middle
from tabsight.sources.local import local_frame
from tabsight.sources.staging import ensure_rows

CHANGE_SCHEMA = (
    "row_number long, column string, operation string, before string, after string, reason string"
)

_SPARK_TYPE = {NUMERIC: "double", DATE: "timestamp", BOOLEAN: "boolean", CATEGORICAL: "string", TEXT: "string"}
# Names and reasons of the entries of a change log.
_REASONS = {
    NUMERIC: ("standardize_numeric", "Normalized numeric text into a numeric value."),
    CATEGORICAL: ("normalize_categorical", "Normalized categorical text for consistent grouping and reporting."),
    DATE: ("standardize_date", "Converted date text into datetime objects."),
    BOOLEAN: ("standardize_boolean", "Converted boolean-like text into boolean values."),
}
_DROP_REASON = "Configured drop_row strategy encountered a missing value."


@dataclass(frozen=True)
class Cleaned:
    """Lazy results of :func:`clean`."""

    rows: DataFrame
    change_log: DataFrame
    report: DataFrame
    strategies: dict[str, str]
    replacements: dict[str, Any]
    prepared: DataFrame
    parts: dict[str, Any]

    def written(self, path: str) -> Cleaned:
        """The same results from one scan: rows, changes and marks are written to ``path`` once, where rows and log are
        read by column, and the counters are taken on the way.

        Counters are those of the tasks whose output was committed, so a task that ran twice counts once.
        """
        observation, parts = Observation(), self.parts
        kept, changes = _free_names(self.rows, "kept", "changes")
        observed = self.prepared.observe(observation, *parts["measures"])
        staged = observed.select(*parts["columns"], parts["kept"].alias(kept), F.array_compact(F.array(*parts["changes"])).alias(changes))
        staged.write.mode("overwrite").parquet(path)
        whole = self.rows.sparkSession.read.schema(staged.schema).parquet(path)
        rows = whole.filter(F.col(kept)).drop(kept, changes)
        log = whole.select(F.col(ROW).alias("row_number"), F.explode(changes).alias("_change")).select("row_number", "_change.*")
        found, names = observation.get, self.report.columns
        report = self.report  # a table without rows may leave nothing to observe
        if set(names) <= set(found):
            report = local_frame(rows.sparkSession, [tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names))
        return replace(self, rows=rows, change_log=log, report=report)


def _free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column has."""
    longest = "_" * max(len(c) for c in df.columns)
    return [f"{longest}{name}" for name in wanted]


def default_strategy(detected_type: str) -> str:
    if detected_type == NUMERIC:
        return "median"
    return "leave_as_null" if detected_type == TEXT else "mode"


def choose_strategies(types: dict[str, str], config: Config) -> dict[str, str]:
    chosen = {}
    for column, detected in types.items():
        strategy = config.missing_value_overrides.get(column, default_strategy(detected))
        if strategy not in STRATEGIES:
            raise ValueError(f"Unknown missing-value strategy {strategy!r} for column {column!r}.")
        if detected == BOOLEAN and strategy in ("mean", "median"):
            raise ValueError(f"Strategy {strategy!r} would put a number into the boolean column {column!r}.")
        chosen[column] = strategy
    return chosen


def replacements(
    standardized: DataFrame,
    missing: dict[str, Column],
    types: dict[str, str],
    strategies: dict[str, str],
    config: Config,
    small_group: int = SMALL_GROUP,
) -> dict[str, Any]:
    """Fill value per column from all standardized rows.

    One aggregate counts gaps and usable values; medians and modes are then
    worked out only for columns that have a gap to fill.
    """
    names = list(types)
    aggregates = []
    for i, c in enumerate(names):
        aggregates += [F.count(C.col(c)).alias(f"n{i}"), F.count_if(missing[c]).alias(f"gaps{i}")]
        if strategies[c] == "mean" and types[c] == NUMERIC:
            aggregates.append(F.avg(C.col(c)).alias(f"mean{i}"))
    totals = standardized.agg(*aggregates).first().asDict()

    values: dict[str, Any] = {}
    medians, dates, modes = [], [], []
    for i, c in enumerate(names):
        strategy, detected = strategies[c], types[c]
        values[c] = None
        if not totals[f"n{i}"]:
            # No usable value at all; an empty text cannot live in a typed column.
            empty = None if strategy == "leave_as_null" or detected not in (CATEGORICAL, TEXT) else ""
            values[c] = config.fill_values.get(c, empty)
        elif strategy == "constant":
            values[c] = config.fill_values.get(c, _constant(detected))
        elif strategy == "mean":
            values[c] = totals.get(f"mean{i}")
        elif totals[f"gaps{i}"] and strategy == "median":
            {NUMERIC: medians, DATE: dates}.get(detected, modes).append(c)
        elif totals[f"gaps{i}"] and strategy == "mode":
            modes.append(c)

    for columns, rank, to_number in (
        (medians, MEDIAN, lambda c: C.col(c)),
        (dates, upper_middle, lambda c: F.unix_micros(C.col(c))),
    ):
        if columns:
            exprs = {c: to_number(c) for c in columns}
            found = column_order_statistics(standardized, exprs, {"v": rank}, small_group=small_group)
            values |= {c: found[c]["v"] for c in columns}
    for c in dates:
        values[c] = F.timestamp_micros(F.lit(int(values[c])))
    values |= _modes(standardized, modes, types)
    return values


def _constant(detected: str) -> Any:
    return {NUMERIC: 0.0, DATE: None, BOOLEAN: False}.get(detected, "")


def mode_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(slot, value) most frequent non-NULL value per column as text, ties to the first seen."""
    wide = df.select(ROW, *[C.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(columns)])
    long = wide.unpivot([ROW], [f"_c{i}" for i in range(len(columns))], "slot", "value")
    counts = (
        long.filter(F.col("value").isNotNull())
        .groupBy("slot", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"))
    )
    best = F.max_by("value", F.struct(F.col("n"), -F.col("first")))
    return counts.groupBy("slot").agg(best.alias("value"))


def _modes(standardized: DataFrame, columns: list[str], types: dict[str, str]) -> dict[str, Any]:
    if not columns:
        return {}
    rows = {r["slot"]: r["value"] for r in mode_values(standardized, columns).collect()}
    return {c: F.lit(rows[f"_c{i}"]).cast(_SPARK_TYPE[types[c]]) for i, c in enumerate(columns)}


def _literal(value: Any, spark_type: str) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast(spark_type)


def _python_text(c: Column, detected: str) -> Column:
    return C.text_of(c, "boolean") if detected == BOOLEAN else c.cast("string")


def clean(
    df: DataFrame,
    types: dict[str, str],
    config: Config = Config(),
    small_group: int = SMALL_GROUP,
    bucket_rows: int = BUCKET_ROWS,
    partition_by: list[str] | None = None,
) -> Cleaned:
    """Standardize, fill and drop; rows, change log and counters come back lazily.

    ``partition_by`` names raw columns: forward and back fills then stay within rows of equal values there.

    Cells of a dropped row left of the column that drops it are still cleaned
    and logged, cells right of it are not: a cell is *live* unless a drop
    column at its left is missing.
    """
    df = ensure_rows(df)
    types = {c: t for c, t in types.items() if c in df.columns}
    names = [c for c in df.columns if c in types]
    by_kind = C.kinds(df, names)
    strategies = choose_strategies({c: types[c] for c in names}, config)
    options = dict(
        case=config.categorical_case, strip_spaces=config.strip_categoricals, strict_numbers=config.strict_numbers
    )

    # _m* = raw cell missing, _v* = standardized value, then the raw cells themselves.
    prepared = df.select(
        *[C.col(c) for c in df.columns],
        *[C.is_missing(C.col(c), by_kind[c]).alias(f"_m{i}") for i, c in enumerate(names)],
        *[C.standardize_cell(C.col(c), types[c], by_kind[c], **options).alias(f"_v{i}") for i, c in enumerate(names)],
    )
    standardized = prepared.select(
        ROW, *[F.col(f"_m{i}") for i in range(len(names))], *[F.col(f"_v{i}").alias(c) for i, c in enumerate(names)]
    )
    missing = {c: F.col(f"_m{i}") for i, c in enumerate(names)}
    filler = replacements(standardized, missing, {c: types[c] for c in names}, strategies, config, small_group)

    live, blocked = {}, F.lit(False)
    for i, c in enumerate(names):
        live[c] = ~blocked
        if strategies[c] == "drop_row":
            blocked = blocked | F.col(f"_m{i}")

    above, below = {}, {}
    for i, c in enumerate(names):
        if strategies[c] == "forward_fill":
            # A live cell that was there counts even when it held no usable value.
            above[f"_f{i}"] = F.when(live[c] & ~F.col(f"_m{i}"), F.struct(F.col(f"_v{i}").alias("v")))
        elif strategies[c] == "back_fill":
            below[f"_f{i}"] = F.when(F.col(f"_v{i}").isNotNull(), F.struct(F.col(f"_v{i}").alias("v")))
    if above or below:
        prepared = fill_columns(prepared, above, below, bucket_rows, partition_by)

    cleaned, changes, counters = {}, [], {"filled": [], "numeric": [], "categorical": []}
    for i, c in enumerate(names):
        detected, strategy, spark_type = types[c], strategies[c], _SPARK_TYPE[types[c]]
        gap, value, raw = F.col(f"_m{i}"), F.col(f"_v{i}"), C.col(c)
        fill = _literal(filler[c], spark_type)
        if strategy == "forward_fill":
            fill = F.when(F.col(f"_f{i}").isNotNull(), F.col(f"_f{i}.v")).otherwise(fill)
        elif strategy == "back_fill":
            fill = F.col(f"_f{i}.v")
        cleaned[c] = F.when(gap, fill).otherwise(value)

        filled = gap & live[c]
        if strategy == "drop_row":
            filled = F.lit(False)
            changes.append(_change(gap & live[c], c, "drop_row", raw, F.lit(None), _DROP_REASON))
        else:
            if strategy == "leave_as_null":
                filled = filled & fill.isNotNull()
            after = _python_text(fill, detected)
            changes.append(_change(filled, c, "fill_missing", raw, after, f"Applied {strategy} strategy."))
        counters["filled"].append(filled)
        if detected in _REASONS:
            operation, reason = _REASONS[detected]
            changed = ~gap & live[c] & value.isNotNull() & _differs(raw, by_kind[c], value, detected)
            changes.append(_change(changed, c, operation, raw, _python_text(value, detected), reason))
            if detected == NUMERIC:
                counters["numeric"].append(changed)
            elif detected == CATEGORICAL:
                counters["categorical"].append(changed)

    kept = ~blocked
    columns = [F.col(ROW), *[cleaned[c].alias(c) if c in cleaned else C.col(c) for c in df.columns if c != ROW]]
    rows = prepared.filter(kept).select(*columns)
    log = prepared.select(
        F.col(ROW).alias("row_number"), F.explode(F.array_compact(F.array(*changes))).alias("_change")
    ).select("row_number", "_change.*")

    def tally(flags: list[Column]) -> Column:
        cells = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags], F.lit(0))
        return F.coalesce(F.sum(cells), F.lit(0)).cast("long")

    measures = [
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(kept).alias("rows_out"),
        F.count_if(blocked).alias("dropped_rows"),
        tally(counters["filled"]).alias("filled_cells"),
        tally(counters["numeric"]).alias("standardized_numeric_cells"),
        tally(counters["categorical"]).alias("normalized_categorical_cells"),
    ]
    parts = {"columns": columns, "kept": kept, "changes": changes, "measures": measures}
    return Cleaned(rows, log, prepared.agg(*measures), strategies, dict(filler), prepared, parts)


def _change(when: Column, column: str, operation: str, before: Column, after: Column, reason: str) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(column).alias("column"),
            F.lit(operation).alias("operation"),
            before.cast("string").alias("before"),
            after.cast("string").alias("after"),
            F.lit(reason).alias("reason"),
        ),
    )


def _differs(raw: Column, kind: str, value: Column, detected: str) -> Column:
    """Whether the standardized value is unequal to the raw cell under value equality."""
    if detected == CATEGORICAL:
        return value != raw if kind == "string" else F.lit(True)
    if kind == "string":
        return F.lit(True)
    if detected == NUMERIC:
        return value != raw.cast("double")
    if detected == DATE:
        return F.lit(kind != "temporal")
    return F.lit(kind not in ("boolean", "integral"))
