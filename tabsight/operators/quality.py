"""Quality counters and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.config import INFO, WARNING, Config, field_names
from tabsight.functions import cells as C
from tabsight.sources.staging import data_columns

# Texts of the findings, and the confidence below which a type is doubtful.
MALFORMED = "Detected %d malformed row(s) during ingestion."
DUPLICATES = "Detected %d duplicate record(s)."
MISSING = "Column '%s' contains %d missing value(s) out of %d row(s)."
INCONSISTENT = "Column '%s' has %d value(s) that do not fit the inferred %s schema."
UNSURE = "Schema confidence for '%s' is only %.2f."
OUTLYING = "Detected %d potential outlier(s) in '%s'."
LOW_CONFIDENCE = 0.65

ISSUE_SCHEMA = (
    "severity string, code string, message string, column string, row_number long, details map<string,string>"
)


def missing_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(row_count, missing_cell_count) over all rows, in one keyless aggregate."""
    columns = columns or data_columns(df)
    by_kind = C.kinds(df, columns)
    per_row = reduce(
        lambda a, b: a + b,
        [C.is_missing(C.col(c), by_kind[c]).cast("int") for c in columns],
        F.lit(0),
    )
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(per_row), F.lit(0)).cast("long").alias("missing_cell_count"),
    )


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """32-byte SHA-256 of a row under a length-prefixed encoding, so unlike rows differ."""
    by_kind = C.kinds(df, columns)
    parts = []
    for c in columns:
        cell = C.col(c)
        if by_kind[c] == "floating":
            cell = cell.cast("double") + F.lit(0.0)
        text = cell.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(duplicate_row_count): extra copies of identical raw rows, NULLs equal.

    The shuffle carries a 32-byte digest and a partial count per distinct row,
    never the row; copies of a hot row are combined before they move.
    """
    columns = columns or data_columns(df)
    copies = df.groupBy(row_digest(df, columns).alias("_digest")).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_row_count"))


def quality(df: DataFrame, malformed: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row of counters: rows, columns, malformed, duplicates, missing cells."""
    columns = columns or data_columns(df)
    counters = {
        "row_count": None, "column_count": F.lit(len(columns)).cast("long"), "malformed_row_count": None,
        "duplicate_row_count": None, "missing_cell_count": None,
    }
    parts = [missing_cells(df, columns), duplicate_rows(df, columns)]
    if malformed is not None:
        parts.append(malformed.agg(F.count(F.lit(1)).alias("malformed_row_count")))
    # One row a part, each with its own counters; their union is added up.
    zero = F.lit(0).cast("long")
    rows = [part.select(*[F.col(c) if c in part.columns else zero.alias(c) for c in counters]) for part in parts]
    total = reduce(DataFrame.unionByName, rows)
    return total.agg(*[(F.max(value) if value is not None else F.sum(c)).alias(c) for c, value in counters.items()])


def with_dataset(df: DataFrame, name: str | None = None) -> DataFrame:
    """Key a report table by dataset so that rules run over many datasets at once."""
    if "dataset" in df.columns and name is None:
        return df
    return df.withColumn("dataset", F.lit(name or "dataset"))


def issue(order, position, severity, code, message, column=None, details=None) -> list[Column]:
    def text(value):
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    empty = F.create_map().cast("map<string,string>")
    return [
        F.col("dataset"),
        F.lit(order).alias("rule_order") if isinstance(order, int) else order.alias("rule_order"),
        (position if isinstance(position, Column) else F.lit(position)).cast("int").alias("position"),
        text(severity).alias("severity"),
        text(code).alias("code"),
        text(message).alias("message"),
        text(column).alias("column"),
        F.lit(None).cast("long").alias("row_number"),
        (details if details is not None else empty).alias("details"),
    ]


def findings(
    profile: DataFrame,
    quality_row: DataFrame,
    outliers: DataFrame,
    config: Config = Config(),
) -> DataFrame:
    """Quality findings of every dataset, in rule order, then column order.

    ``outliers`` may be the outlier rows or their (column, outlier_count) totals.
    """
    profile, totals = with_dataset(profile), with_dataset(quality_row)
    found = with_dataset(outliers)
    if "outlier_count" not in found.columns:
        found = found.groupBy("dataset", "column").agg(F.count(F.lit(1)).alias("outlier_count"))

    def details(*pairs) -> Column:
        flat = [x for key, value in pairs for x in (F.lit(key), value.cast("string"))]
        return F.create_map(*flat)

    bad, copies = F.col("malformed_row_count"), F.col("duplicate_row_count")
    malformed = totals.filter(bad > 0).select(
        *issue(1, 0, WARNING, "malformed_rows",
               F.format_string(MALFORMED, bad),
               details=details(("malformed_rows", bad)))
    )
    duplicates = totals.filter(copies > 0).select(
        *issue(2, 0, WARNING, "duplicate_rows",
               F.format_string(DUPLICATES, copies),
               details=details(("duplicate_rows", copies)))
    )
    columns = profile.join(totals.select("dataset", "row_count"), "dataset")
    name, rows = F.col("column"), F.greatest(F.lit(1), F.col("row_count"))
    gaps, invalid = F.col("missing_count"), F.col("invalid_count")
    rate = gaps / rows
    severity = F.when(rate < config.quality_issue_threshold, INFO).otherwise(WARNING)
    missing = columns.filter(gaps > 0).select(
        *issue(3, F.col("position"), severity, "missing_values",
               F.format_string(MISSING, name, gaps, rows),
               name, details(("missing_count", gaps), ("missing_rate", rate)))
    )
    inconsistent = columns.filter(invalid > 0).select(
        *issue(4, F.col("position"), WARNING, "inconsistent_values",
               F.format_string(INCONSISTENT, name, invalid, F.col("detected_type")),
               name, details(("invalid_count", invalid), ("detected_type", F.col("detected_type"))))
    )
    unsure = columns.filter((F.col("confidence") < LOW_CONFIDENCE) & (F.col("non_missing_count") > 0)).select(
        *issue(5, F.col("position"), INFO, "low_schema_confidence",
               F.format_string(UNSURE, name, F.col("confidence")), name)
    )
    count = F.col("outlier_count")
    outlying = found.join(profile.select("dataset", "column", "position"), ["dataset", "column"]).select(
        *issue(6, F.col("position"), WARNING, "outliers_detected",
               F.format_string(OUTLYING, count, name),
               name, details(("outlier_count", count)))
    )
    every = reduce(DataFrame.unionByName, [malformed, duplicates, missing, inconsistent, unsure, outlying])
    # Rules 3-5 alternate within a column.
    group = F.when(F.col("rule_order").isin(3, 4, 5), 3).otherwise(F.col("rule_order"))
    return every.orderBy("dataset", group, "position", "rule_order").select(
        "dataset", *[F.col(c) for c in field_names(ISSUE_SCHEMA)]
    )
