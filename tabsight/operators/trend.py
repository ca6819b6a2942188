"""Linear trends over dates and their anomalies."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.config import DATE, INFO, NUMERIC, ROW, field_names
from tabsight.functions import cells as C
from tabsight.operators.profile import columns_of
from tabsight.operators.stats import numeric_exprs
from tabsight.sources.local import local_frame
from tabsight.sources.staging import ensure_rows

TREND_SCHEMA = (
    "date_column string, value_column string, slope double, direction string, r_squared double, anomaly_count long"
)
ANOMALY_SCHEMA = (
    "date_column string, value_column string, row_number long, day_number int, "
    "predicted double, actual double, zscore double"
)

# Fixed value: the ordinal of 1970-01-01 when 0001-01-01 is day 1.
EPOCH_ORDINAL = 719_163


@dataclass(frozen=True)
class Fit:
    date_column: str
    value_column: str
    n: int
    slope: float
    intercept: float
    r_squared: float
    residual_sd: float | None


def day_ordinal(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)) + EPOCH_ORDINAL


def _pairs(df: DataFrame, types: dict[str, str], dates, values, max_values: int | None) -> list[tuple[str, str]]:
    dates = [c for c in (dates or columns_of(types, DATE)) if c in df.columns]
    values = [c for c in (values or columns_of(types, NUMERIC)[:max_values]) if c in df.columns]
    return [(d, v) for d in dates for v in values]


def _wide(df: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """One day column per date column and one number per value column."""
    dates = list(dict.fromkeys(d for d, _ in pairs))
    values = list(dict.fromkeys(v for _, v in pairs))
    kinds = C.kinds(df, dates)
    numbers = numeric_exprs(df, values)
    day = {d: f"_d{i}" for i, d in enumerate(dates)}
    num = {v: f"_v{i}" for i, v in enumerate(values)}
    wide = df.select(
        ROW,
        *[day_ordinal(C.parse_date(C.col(d), kinds[d])).alias(day[d]) for d in dates],
        *[numbers[v].alias(num[v]) for v in values],
    )
    return wide, day, num


def fit_trends(
    df: DataFrame,
    types: dict[str, str],
    date_columns: list[str] | None = None,
    value_columns: list[str] | None = None,
    max_values: int | None = None,
) -> list[Fit]:
    """Least-squares line of each value on the day, for at least three complete rows.

    Two keyless aggregates whatever the number of pairs: the fit, then the
    spread of its residuals.
    """
    df = ensure_rows(df)
    pairs = _pairs(df, types, date_columns, value_columns, max_values)
    if not pairs:
        return []
    wide, day, num = _wide(df, pairs)
    aggregates = []
    for k, (d, v) in enumerate(pairs):
        x, y = F.col(day[d]).cast("double"), F.col(num[v])
        both = x.isNotNull() & y.isNotNull()
        aggregates += [
            F.regr_count(y, x).alias(f"n{k}"),
            F.regr_slope(y, x).alias(f"slope{k}"),
            F.regr_intercept(y, x).alias(f"intercept{k}"),
            F.regr_r2(y, x).alias(f"r2{k}"),
            F.min(F.when(both, x)).alias(f"xlow{k}"),
            F.max(F.when(both, x)).alias(f"xhigh{k}"),
            F.min(F.when(both, y)).alias(f"ylow{k}"),
            F.max(F.when(both, y)).alias(f"yhigh{k}"),
        ]
    row = wide.agg(*aggregates).first()
    found = []
    for k, (d, v) in enumerate(pairs):
        if row[f"n{k}"] < 3 or row[f"xlow{k}"] == row[f"xhigh{k}"]:
            continue
        if row[f"ylow{k}"] == row[f"yhigh{k}"]:
            found.append((d, v, row[f"n{k}"], 0.0, row[f"ylow{k}"], 1.0))
        else:
            found.append((d, v, row[f"n{k}"], row[f"slope{k}"], row[f"intercept{k}"], row[f"r2{k}"]))
    if not found:
        return []
    spread = wide.agg(
        *[F.stddev_samp(_residual(day[d], num[v], slope, icpt)).alias(f"sd{k}") for k, (d, v, _, slope, icpt, _) in enumerate(found)]
    ).first()
    return [Fit(*f, residual_sd=spread[f"sd{k}"]) for k, f in enumerate(found)]


def _predicted(day: str, slope: float, intercept: float) -> Column:
    return F.lit(intercept) + F.lit(slope) * F.col(day)


def _residual(day: str, num: str, slope: float, intercept: float) -> Column:
    return F.col(num) - _predicted(day, slope, intercept)


def trend_anomalies(
    df: DataFrame, types: dict[str, str], fits: list[Fit], zscore_threshold: float = 3.0
) -> DataFrame:
    """Rows far from the fitted line, one record each; never gathered in a list.

    The lines are a few literals, so this is a shuffle-free pass.
    """
    df = ensure_rows(df)
    usable = [f for f in fits if f.residual_sd and not math.isnan(f.residual_sd)]
    if not usable:
        return local_frame(df.sparkSession, [], ANOMALY_SCHEMA)
    wide, day, num = _wide(df, [(f.date_column, f.value_column) for f in usable])
    hits = []
    for f in usable:
        d, v = day[f.date_column], num[f.value_column]
        score = F.abs(_residual(d, v, f.slope, f.intercept) / f.residual_sd)
        record = F.struct(
            F.lit(f.date_column).alias("date_column"),
            F.lit(f.value_column).alias("value_column"),
            F.col(d).alias("day_number"),
            _predicted(d, f.slope, f.intercept).alias("predicted"),
            F.col(v).alias("actual"),
            score.alias("zscore"),
        )
        hits.append(F.when(score >= zscore_threshold, record))
    exploded = wide.select(F.col(ROW).alias("row_number"), F.explode(F.array_compact(F.array(*hits))).alias("_hit"))
    return exploded.select("row_number", "_hit.*").select(*field_names(ANOMALY_SCHEMA))


def trends(
    df: DataFrame,
    types: dict[str, str],
    zscore_threshold: float = 3.0,
    date_columns: list[str] | None = None,
    value_columns: list[str] | None = None,
    fits: list[Fit] | None = None,
) -> DataFrame:
    """One row per (date, value) pair: slope per day, direction, fit and number of anomalies."""
    df = ensure_rows(df)
    if fits is None:
        fits = fit_trends(df, types, date_columns, value_columns)
    spark = df.sparkSession
    rows = []
    for i, f in enumerate(fits):
        direction = "increasing" if f.slope > 0 else "decreasing" if f.slope < 0 else "flat"
        rows.append((i, f.date_column, f.value_column, f.slope, direction, f.r_squared))
    lines = local_frame(spark, rows, "_order int, date_column string, value_column string, slope double, direction string, r_squared double"
    )
    keys = ["date_column", "value_column"]
    counts = trend_anomalies(df, types, fits, zscore_threshold).groupBy(*keys).agg(F.count(F.lit(1)).alias("anomaly_count"))
    return (
        lines.join(counts, keys, "left")
        .withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0)))
        .orderBy("_order")
        .select(*field_names(TREND_SCHEMA))
    )


def anomaly_findings(anomalies: DataFrame) -> DataFrame:
    """Trend anomalies as issue records."""
    message = F.format_string(
        "Row %d in '%s' deviates from the fitted trend around '%s'.",
        F.col("row_number"), F.col("value_column"), F.col("date_column"),
    )
    details = F.create_map(
        F.lit("date_column"), F.col("date_column"),
        F.lit("zscore"), F.col("zscore").cast("string"),
        F.lit("predicted"), F.col("predicted").cast("string"),
        F.lit("actual"), F.col("actual").cast("string"),
    )
    return anomalies.select(
        F.lit(INFO).alias("severity"),
        F.lit("trend_anomaly").alias("code"),
        message.alias("message"),
        F.col("value_column").alias("column"),
        "row_number",
        details.alias("details"),
    )
