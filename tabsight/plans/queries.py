"""Operators applied to the given tables, one entry per operator.

Each query takes (spark, table directory) and reads whole tables. Missing
tokens, decorated numbers and date layouts are derived from the tables row by
row, since they hold clean values.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.config import ROW, Config, FilterSpec
from tabsight.functions import cells as C
from tabsight.functions.filters import slice_rows
from tabsight.operators import charts, cleaning, model, outliers, quality, stats, trend
from tabsight.operators.insights import insights
from tabsight.operators.profile import column_types, profile
from tabsight.sources.csv import audit_files, scan_csv
from tabsight.sources.reports import to_report_value
from tabsight.sources.staging import number_rows, prepare_session, shared_folder, use_order_key

Query = Callable[[SparkSession, str], DataFrame]

LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENT_TYPES = {"event_id": "numeric", "ts": "date", "user_id": "numeric", "event_type": "categorical", "value": "numeric"}
ORDER_TYPES = {
    "o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric",
    "o_orderdate": "date", "o_orderpriority": "categorical",
}
LINEITEM_TYPES = {
    **{c: "numeric" for c in LINEITEM_NUMBERS},
    "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "date",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_order_key(table(spark, sf_dir, "events"), "event_id")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_order_key(table(spark, sf_dir, "orders"), "o_orderkey")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(table(spark, sf_dir, "lineitem"))


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as text, with missing tokens and an unreadable number written over some cells."""
    k = F.col("event_id")
    return events(spark, sf_dir).select(
        ROW,
        "event_id",
        F.when(k % 5 == 0, " - ").when(k % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(k % 7 == 0, "N/A").when(k % 13 == 0, "broken").otherwise(F.col("value").cast("string")).alias("value"),
    )


GAPPY_TYPES = {"event_id": "numeric", "event_type": "categorical", "value": "numeric"}


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Profiles and quality ------------------------------------------------------------------------------


def profile_query(name: str, sample_rows: int = 0) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = profile(table(spark, sf_dir, name), sample_rows=sample_rows).drop("position", "sample_values", "top_values")
        return rounded(
            found, 4, "confidence", "numeric_min", "numeric_max", "numeric_mean", "numeric_median", "numeric_stddev"
        )

    return query


def top_values_orders(spark, sf_dir):
    found = profile(orders(spark, sf_dir), ["o_custkey", "o_orderstatus", "o_orderpriority"], sample_rows=0)
    return found.select("column", F.posexplode("top_values").alias("rank", "top")).select(
        "column", "rank", "top.value", F.col("top.count").alias("n")
    )


def top_values_typed(spark, sf_dir):
    """Top values of dates and floats read the same whether all rows or the first 5,000 are asked for."""
    typed = orders(spark, sf_dir).select(
        ROW, F.to_date("o_orderdate").alias("day"), ((F.col("o_orderkey") % 7).cast("float") / F.lit(10).cast("float")).cast("float").alias("tenth")
    )
    parts = [
        profile(typed, sample_rows=n).select(F.lit(n).alias("rows_asked"), "column", F.posexplode("top_values").alias("rank", "top"))
        for n in (0, 5_000)
    ]
    return parts[0].unionByName(parts[1]).select("rows_asked", "column", "rank", "top.value", F.col("top.count").alias("n"))


def profile_aggregated_orders(spark, sf_dir):
    """A frame that is no file scan."""
    grouped = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 500).alias("bucket")).agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("largest"), F.max("o_orderdate").alias("latest")
    )
    found = profile(grouped).drop("position", "sample_values", "top_values")
    return rounded(found, 4, "confidence", "numeric_min", "numeric_max", "numeric_mean", "numeric_median", "numeric_stddev")


def sample_values_events(spark, sf_dir):
    found = profile(gappy_events(spark, sf_dir), sample_rows=0)
    return found.select("column", F.posexplode("sample_values").alias("rank", "value"))


def missing_cells_events(spark, sf_dir):
    return quality.missing_cells(gappy_events(spark, sf_dir))


def quality_events(spark, sf_dir):
    return quality.quality(gappy_events(spark, sf_dir), columns=["event_type", "value"])


def duplicate_rows_lineitem(spark, sf_dir):
    return quality.duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey", "l_quantity"])


def duplicate_documents(spark, sf_dir):
    return quality.duplicate_rows(table(spark, sf_dir, "documents"), ["text"])


def quality_findings_events(spark, sf_dir):
    df = gappy_events(spark, sf_dir)
    found = profile(df, sample_rows=0)
    flagged = outliers.outliers(df, column_types(found))
    issues = quality.findings(found, quality.quality(df), flagged)
    return issues.select("severity", "code", "column", "message")


# Cells ---------------------------------------------------------------------------------------------


def parse_number_cells(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(14,2)").cast("string")
    text = (
        F.when(k % 8 == 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
        .when(k % 8 == 1, F.concat(F.lit("("), price, F.lit(")")))
        .when(k % 8 == 2, F.concat(price, F.lit("%")))
        .when(k % 8 == 3, F.concat(F.lit("\t"), price, F.lit("  ")))
        .when(k % 8 == 4, F.concat(F.lit("("), price, F.lit(")%")))
        .when(k % 8 == 5, F.concat(F.lit("Order#"), price))
        .when(k % 8 == 6, F.concat(price, F.lit("e2 USD")))
        .otherwise(F.lit("n/a"))
    )
    return orders(spark, sf_dir).select("o_orderkey", F.round(C.parse_number(text), 4).alias("number"))


def parse_number_brands(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.parse_number(F.col("p_brand")).alias("number"))


def parse_boolean_cells(spark, sf_dir):
    k = F.col("o_orderkey")
    words = [" Yes ", "NO", "t", "F", "1", "0", "maybe", "None"]
    text = F.element_at(F.array(*[F.lit(w) for w in words]), (k % 8 + 1).cast("int"))
    parsed = C.parse_boolean(text)
    return orders(spark, sf_dir).select("o_orderkey", parsed.cast("int").alias("flag"))


def parse_date_cells(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    layouts = [
        "yyyy-MM-dd", "yyyy/M/d", "M/d/yyyy", "dd/MM/yyyy", "MMM d yyyy", "MMMM dd yyyy", "yyyyMMdd",
        "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+05:30'", "yyyy/M/d H:m:s", "yyyy-MM", "d MMM yyyy",
    ]
    text = F.date_format(d, layouts[0])
    for i, layout in enumerate(layouts):
        text = F.when(k % len(layouts) == i, F.date_format(d, layout)).otherwise(text)
    return orders(spark, sf_dir).select("o_orderkey", C.parse_date(text).alias("parsed"))


def normalize_text_cells(spark, sf_dir):
    text = F.concat(F.lit(" \t"), F.col("c_mktsegment"), F.lit("   of\n"), F.lower("c_name"), F.lit("  "))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        C.normalize_text(text, "lower").alias("lowered"),
        C.normalize_text(text, "upper").alias("uppered"),
        C.normalize_text(text, "title").alias("titled"),
        C.fold_value(text).alias("folded"),
        C.collapse_text(text).alias("collapsed"),
    )


def standardize_events(spark, sf_dir):
    return C.standardize(gappy_events(spark, sf_dir), GAPPY_TYPES)


def missing_tokens_events(spark, sf_dir):
    return gappy_events(spark, sf_dir).select(
        "event_id",
        C.is_missing(F.col("event_type")).cast("int").alias("type_missing"),
        C.is_missing(F.col("value")).cast("int").alias("value_missing"),
    )


# Filters -------------------------------------------------------------------------------------------


def filter_query(*specs: FilterSpec) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        cleaned = C.standardize(gappy_events(spark, sf_dir), GAPPY_TYPES)
        return slice_rows(cleaned, specs).select("event_id", "event_type", "value")

    return query


FILTERS = {
    "filter_equals": [FilterSpec("event_type", "equals", "click")],
    "filter_not_equals": [FilterSpec("event_type", "not_equals", "click")],
    "filter_contains": [FilterSpec("event_type", "contains", "ON")],
    "filter_greater_than": [FilterSpec("value", "greater_than", "50")],
    "filter_greater_equal": [FilterSpec("value", "greater_equal", 50)],
    "filter_less_than": [FilterSpec("value", "less_than", "$10.00")],
    "filter_less_equal": [FilterSpec("value", "less_equal", 10)],
    "filter_between": [FilterSpec("value", "between", 10, "20")],
    "filter_in": [FilterSpec("event_type", "in", ["view", "error", None])],
    "filter_conjunction": [FilterSpec("event_type", "equals", "view"), FilterSpec("value", "greater_than", 20)],
}


# Outliers ------------------------------------------------------------------------------------------


def outlier_query(name: str, key: str, column: str, iqr: float = 1.5, z: float = 3.0) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = use_order_key(table(spark, sf_dir, name), key)
        found = outliers.outliers(df, {column: "numeric"}, iqr, z)
        return rounded(found, 6, "score", "lower_bound", "upper_bound")

    return query


# Cleaning ------------------------------------------------------------------------------------------


def clean_events(spark, sf_dir, **overrides) -> cleaning.Cleaned:
    settings = {"event_id": "leave_as_null", "event_type": "leave_as_null", "value": "leave_as_null"}
    fill_values = overrides.pop("fill_values", {})
    config = Config(missing_value_overrides={**settings, **overrides}, fill_values=fill_values)
    return cleaning.clean(gappy_events(spark, sf_dir), GAPPY_TYPES, config)


def fill_query(**overrides) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(clean_events(spark, sf_dir, **dict(overrides)).rows, 6, "value")

    return query


def change_log(spark, sf_dir):
    return clean_events(spark, sf_dir, event_type="mode", value="forward_fill").change_log


def clean_report(spark, sf_dir):
    return clean_events(spark, sf_dir, event_type="drop_row", value="median").report


def fill_date_median(spark, sf_dir):
    """Upper middle of the dates, written over gaps in the date column."""
    gap = F.when(F.col("event_id") % 4 == 0, "null").otherwise(F.col("ts").cast("string"))
    df = events(spark, sf_dir).select(ROW, "event_id", gap.alias("ts"))
    config = Config(missing_value_overrides={"ts": "median", "event_id": "leave_as_null"})
    return cleaning.clean(df, {"event_id": "numeric", "ts": "date"}, config).rows.select("event_id", "ts")


# Analysis ------------------------------------------------------------------------------------------


def summary_statistics(spark, sf_dir):
    found = stats.summary(table(spark, sf_dir, "lineitem"), LINEITEM_TYPES)
    return rounded(found, 4, "mean", "median", "stddev", "min", "q1", "q3", "max")


def correlations_lineitem(spark, sf_dir):
    return rounded(stats.correlations(table(spark, sf_dir, "lineitem"), LINEITEM_TYPES), 6, "correlation")


def correlations_events(spark, sf_dir):
    """Columns with gaps, so that the complete pairs differ from the columns."""
    cleaned = C.standardize(gappy_events(spark, sf_dir), GAPPY_TYPES)
    user = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 9 != 0, F.col("user_id")).alias("user_id"))
    joined = cleaned.join(user.withColumn("event_id", F.col("event_id").cast("double")), "event_id")
    types = {"event_id": "numeric", "value": "numeric", "user_id": "numeric"}
    return rounded(stats.correlations(joined, types), 6, "correlation")


def segment_query(df_of, types, measure: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stats.segments(df_of(spark, sf_dir), types, measure=measure)
        numbers = F.col("numeric_aggregates")
        return found.select(
            "dimension", "value", "row_count",
            F.round("share", 6).alias("share"),
            F.round(numbers[f"mean_{measure}"], 4).alias("mean"),
            F.round(numbers[f"median_{measure}"], 4).alias("median"),
        )

    return query


def trends_orders(spark, sf_dir):
    found = trend.trends(orders(spark, sf_dir), ORDER_TYPES, 1.5, ["o_orderdate"], ["o_totalprice", "o_custkey"])
    return rounded(found, 6, "slope", "r_squared")


def trends_events(spark, sf_dir):
    found = trend.trends(events(spark, sf_dir), EVENT_TYPES, value_columns=["value", "user_id"])
    return rounded(found, 6, "slope", "r_squared")


def trend_anomalies_events(spark, sf_dir):
    df = events(spark, sf_dir)
    fits = trend.fit_trends(df, EVENT_TYPES, value_columns=["value"])
    return rounded(trend.trend_anomalies(df, EVENT_TYPES, fits), 4, "predicted", "actual", "zscore")


REGRESSION = ("l_extendedprice", ["l_quantity", "l_discount"])


def regression_fit(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    config = Config(target_column=REGRESSION[0], feature_columns=REGRESSION[1])
    found = model.model(df, LINEITEM_TYPES, config)
    return found.select(
        "target_column",
        F.round("intercept", 2).alias("intercept"),
        *[F.round(F.col("coefficients")[f], 2).alias(f"w_{f}") for f in REGRESSION[1]],
    )


def regression_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    fit = model.fit_regression(df, *REGRESSION)
    found = model.regression_metrics(df, fit)
    return found.select(
        F.round("r_squared", 6).alias("r_squared"), F.round("rmse", 3).alias("rmse"),
        F.round("mae", 3).alias("mae"), F.col("observations").cast("long").alias("observations"),
    )


def predictions(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    fit = model.fit_regression(df, "o_totalprice", ["o_custkey"])
    return model.predict(df, fit).select("o_orderkey", F.round("prediction", 0).alias("prediction"))


# Charts and insights -------------------------------------------------------------------------------


def histogram_events(spark, sf_dir):
    return rounded(charts.histogram(events(spark, sf_dir), "value"), 4, "start", "end")


def value_counts_orders(spark, sf_dir):
    return charts.value_counts(orders(spark, sf_dir), "o_orderpriority").select("value", F.col("count").alias("n"), "rank")


def value_counts_parts(spark, sf_dir):
    parts = use_order_key(table(spark, sf_dir, "part"), "p_partkey")
    return charts.value_counts(parts, "p_name").select("value", F.col("count").alias("n"), "rank")


def trend_series_orders(spark, sf_dir):
    return charts.trend_series(orders(spark, sf_dir), "o_orderdate", "o_totalprice")


def trend_series_by_day(spark, sf_dir):
    found = charts.trend_series(orders(spark, sf_dir), "o_orderdate", "o_totalprice", bucket="day")
    return rounded(found, 6, "value")


def scatter_points_lineitem(spark, sf_dir):
    found = charts.scatter_points(lineitem(spark, sf_dir), "l_quantity", "l_extendedprice")
    return found.select("a", "b")


def chart_plan_orders(spark, sf_dir):
    df = orders(spark, sf_dir)
    types = ORDER_TYPES
    plan = charts.chart_plan(
        df, types, stats.summary(df, types), trend.trends(df, types), stats.correlations(df, types)
    )
    return plan.select("position", "kind", "title", "description")


def insights_orders(spark, sf_dir):
    df = orders(spark, sf_dir)
    found = profile(df, sample_rows=0)
    types = column_types(found)
    report = insights(
        quality.quality(df), found, outliers.outliers(df, types), stats.correlations(df, types),
        trend.trends(df, types), model.model(df, types),
    )
    return report.select(
        "executive_summary", *[F.array_join(c, " | ").alias(c) for c in ("key_drivers", "risks", "recommended_actions")]
    )


# Sources -------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder for files written by a query."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _write_lines(df: DataFrame, header: str, line: Column, path: str) -> str:
    """Text lines under a header line in every file."""
    writer = df.select(line.alias(header)).write.option("header", "true").option("sep", "\u0001")
    writer.option("quote", "").option("escape", "").option("emptyValue", "").csv(path)
    return path


def scan_csv_orders(spark, sf_dir):
    source = orders(spark, sf_dir).orderBy("o_orderkey")
    path = _scratch(spark, "orders-csv")
    source.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").write.option("header", "true").csv(path)
    rows = scan_csv(spark, path).rows
    return rows.select(
        F.col(ROW).alias("row_number"), "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.round(C.parse_number(F.col("o_totalprice")), 2).alias("o_totalprice"),
    )


def malformed_rows_orders(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    line = (
        F.when(F.col("o_orderkey") % 10 == 3, F.concat_ws(",", k, "o_orderstatus"))
        .when(F.col("o_orderkey") % 10 == 7, F.concat_ws(",", k, "o_orderstatus", "o_orderpriority", F.lit("extra")))
        .otherwise(F.concat_ws(",", k, "o_orderstatus", "o_orderpriority"))
    )
    path = _write_lines(orders(spark, sf_dir), "o_orderkey,o_orderstatus,o_orderpriority", line, _scratch(spark, "malformed"))
    return scan_csv(spark, path).malformed.select("expected_fields", "actual_fields", "raw_preview")


def audit_files_customers(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    root = _scratch(spark, "audit")
    paths = []
    for name, sep in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("pipe", "|")):
        fields = ["c_custkey", "c_name", "c_mktsegment"]
        line = F.concat_ws(sep, *[F.col(c).cast("string") for c in fields])
        paths.append(_write_lines(df, sep.join(fields), line, f"{root}/{name}"))
    found = audit_files(spark, paths).filter(F.col("error").isNull())
    return found.select("delimiter", "encoding", F.array_join("header", " ").alias("header"), "multi_line").distinct()


def row_numbers_events(spark, sf_dir):
    """Dense numbers under a sort that is not the scan order."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id")
    return number_rows(df, ["user_id", "event_id"]).select("event_id", F.col(ROW).alias("row_number"))


def report_values_customers(spark, sf_dir):
    fields = F.struct("c_custkey", F.when(F.col("c_nationkey") % 5 == 0, None).otherwise(F.col("c_name")).alias("name"))
    return table(spark, sf_dir, "customer").select("c_custkey", to_report_value(fields).alias("payload"))


QUERIES: dict[str, Query] = {
    "profile_lineitem": profile_query("lineitem"),
    "profile_orders": profile_query("orders"),
    "profile_events": profile_query("events"),
    "profile_part": profile_query("part"),
    "profile_customer": profile_query("customer"),
    "profile_labels": profile_query("labels"),
    "profile_documents": profile_query("documents"),
    "profile_sample_events": profile_query("events", 5_000),
    "top_values_orders": top_values_orders,
    "top_values_typed": top_values_typed,
    "profile_aggregated_orders": profile_aggregated_orders,
    "sample_values_events": sample_values_events,
    "missing_cells_events": missing_cells_events,
    "missing_tokens_events": missing_tokens_events,
    "quality_events": quality_events,
    "quality_findings_events": quality_findings_events,
    "duplicate_rows_lineitem": duplicate_rows_lineitem,
    "duplicate_documents": duplicate_documents,
    "parse_number_cells": parse_number_cells,
    "parse_number_brands": parse_number_brands,
    "parse_boolean_cells": parse_boolean_cells,
    "parse_date_cells": parse_date_cells,
    "normalize_text_cells": normalize_text_cells,
    "standardize_events": standardize_events,
    **{name: filter_query(*specs) for name, specs in FILTERS.items()},
    "outliers_both": outlier_query("events", "event_id", "value"),
    "outliers_iqr": outlier_query("events", "event_id", "value", z=1e9),
    "outliers_zscore": outlier_query("events", "event_id", "value", iqr=1e9, z=2.0),
    "outliers_customer": outlier_query("customer", "c_custkey", "c_acctbal", iqr=0.2, z=1.5),
    "fill_mean": fill_query(value="mean"),
    "fill_median": fill_query(value="median"),
    "fill_mode": fill_query(event_type="mode"),
    "fill_mode_first_seen": fill_query(value="mode"),
    "fill_constant": fill_query(value="constant", event_type="constant", fill_values={"value": -1.0}),
    "fill_date_median": fill_date_median,
    "drop_missing_rows": fill_query(event_type="drop_row"),
    "forward_fill": fill_query(value="forward_fill", event_type="forward_fill"),
    "back_fill": fill_query(value="back_fill", event_type="back_fill"),
    "change_log": change_log,
    "clean_report": clean_report,
    "summary_statistics": summary_statistics,
    "correlations": correlations_lineitem,
    "correlations_gappy": correlations_events,
    "segments": segment_query(lineitem, LINEITEM_TYPES, "l_extendedprice"),
    "segments_orders": segment_query(orders, ORDER_TYPES, "o_totalprice"),
    "trends": trends_orders,
    "trends_events": trends_events,
    "trend_anomalies": trend_anomalies_events,
    "regression_fit": regression_fit,
    "regression_metrics": regression_metrics,
    "predictions": predictions,
    "histogram": histogram_events,
    "value_counts": value_counts_orders,
    "value_counts_parts": value_counts_parts,
    "trend_series": trend_series_orders,
    "trend_series_by_day": trend_series_by_day,
    "scatter_points": scatter_points_lineitem,
    "chart_plan": chart_plan_orders,
    "insights": insights_orders,
    "scan_csv": scan_csv_orders,
    "malformed_rows": malformed_rows_orders,
    "audit_files": audit_files_customers,
    "row_numbers": row_numbers_events,
    "report_values": report_values_customers,
}
