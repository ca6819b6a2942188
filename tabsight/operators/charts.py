"""The data behind each chart, and which charts to draw."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.config import BOOLEAN, CATEGORICAL, NUMERIC, ROW
from tabsight.functions import cells as C
from tabsight.operators.profile import columns_of, top_ranked
from tabsight.operators.stats import column_stats, dimension_values, numeric_exprs
from tabsight.sources.local import local_frame
from tabsight.sources.staging import ensure_rows

HISTOGRAM_SCHEMA = "bin int, start double, end double, count long"
GRID_SCHEMA = "bin_a int, bin_b int, a_start double, a_end double, b_start double, b_end double, count long"
CHART_SCHEMA = (
    "position int, kind string, title string, columns array<string>, description string, note string"
)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width bins, about log2(n) of them between 3 and 12; empty bins are kept."""
    spark = df.sparkSession
    expr = numeric_exprs(df, [column])[column]
    s = column_stats(df, {column: expr})[0]
    if not s["n"]:
        return local_frame(spark, [], HISTOGRAM_SCHEMA)
    low, high = s["low"], s["high"]
    if low == high:
        return local_frame(spark, [(0, low - 0.5, low + 0.5, s["n"])], HISTOGRAM_SCHEMA)
    bins = min(12, max(3, math.ceil(math.log2(s["n"])) + 1))
    width = (high - low) / bins
    x = F.col("x")
    slot = F.when(x == high, bins - 1).otherwise(F.least(F.floor((x - low) / F.lit(width)), F.lit(bins - 1)))
    counts = (
        df.select(expr.alias("x"))
        .filter(x.isNotNull())
        .groupBy(slot.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    frame = local_frame(spark, [(i, low + i * width, low + i * width + width) for i in range(bins)], "bin int, start double, end double"
    )
    return frame.join(counts, "bin", "left").select("bin", "start", "end", F.coalesce("count", F.lit(0)).alias("count"))


def value_counts(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """(value, count, rank) of the most frequent non-NULL values, ties to the first seen."""
    df = ensure_rows(df)
    long = dimension_values(df, [column], F.lit(None).cast("double"))
    counts = long.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"))
    return top_ranked(counts, ["slot"], top).orderBy("rank").select("value", F.col("n").alias("count"), "rank")


def trend_series(df: DataFrame, date_column: str, value_column: str, bucket: str | None = None) -> DataFrame:
    """(day, value) of complete pairs by day, or one mean per day with ``bucket='day'``."""
    df = ensure_rows(df)
    kind = C.kinds(df, [date_column])[date_column]
    day = F.date_format(C.parse_date(C.col(date_column), kind), "yyyy-MM-dd")
    value = numeric_exprs(df, [value_column])[value_column]
    points = df.select(ROW, day.alias("day"), value.alias("value")).dropna()
    if bucket == "day":
        return points.groupBy("day").agg(F.avg("value").alias("value")).orderBy("day")
    return points.orderBy("day", ROW).select("day", "value")


def scatter_points(df: DataFrame, column_a: str, column_b: str, max_points: int | None = None) -> DataFrame:
    """(_row, a, b) of complete numeric pairs.

    With ``max_points`` only those rows whose digest of the row number comes first: a random sample that is the same on
    every run, taken in each task before it is merged.
    """
    df = ensure_rows(df)
    exprs = numeric_exprs(df, [column_a, column_b])
    points = df.select(ROW, exprs[column_a].alias("a"), exprs[column_b].alias("b")).dropna()
    if max_points is None:
        return points
    return points.withColumn("_order", F.md5(F.col(ROW).cast("string"))).orderBy("_order", ROW).limit(max_points).drop("_order")


def scatter_grid(df: DataFrame, column_a: str, column_b: str, bins: int = 20) -> DataFrame:
    """(bin_a, bin_b, a_start, a_end, b_start, b_end, count): all complete numeric pairs, counted in equal cells.

    Cells without a pair are left out; the largest values belong to the last cells, and a column of one value has one.
    """
    spark = df.sparkSession
    exprs = numeric_exprs(df, [column_a, column_b])
    pairs = df.select(exprs[column_a].alias("a"), exprs[column_b].alias("b")).dropna()
    edges = {s["column"]: s for s in column_stats(pairs, {"a": F.col("a"), "b": F.col("b")})}
    if not edges["a"]["n"]:
        return local_frame(spark, [], GRID_SCHEMA)

    def cell(name: str):
        low, high = edges[name]["low"], edges[name]["high"]
        width = (high / bins - low / bins) or 1.0
        place = F.least(F.floor((F.col(name) - F.lit(low)) / F.lit(width)), F.lit(bins - 1 if low < high else 0))
        return place.cast("int").alias(f"bin_{name}"), low, width

    (place_a, low_a, width_a), (place_b, low_b, width_b) = cell("a"), cell("b")
    counts = pairs.groupBy(place_a, place_b).agg(F.count(F.lit(1)).alias("count"))  # bins * bins rows at most
    bounds = []
    for name, low, width in (("a", low_a, width_a), ("b", low_b, width_b)):
        at = F.col(f"bin_{name}")
        bounds += [(F.lit(low) + at * width).alias(f"{name}_start"), (F.lit(low) + (at + 1) * width).alias(f"{name}_end")]
    return counts.select("bin_a", "bin_b", *bounds, "count")


def skewed(summary: DataFrame) -> DataFrame:
    """Add ``skewed``: the largest value is over ten times the mean's size."""
    ratio = F.col("max") / F.greatest(F.lit(0.001), F.abs("mean"))
    return summary.withColumn("skewed", (F.col("mean") != 0) & (ratio > 10))


def chart_plan(
    df: DataFrame,
    types: dict[str, str],
    summary: DataFrame,
    trends: DataFrame,
    correlations: DataFrame,
    limit: int = 6,
) -> DataFrame:
    """Which charts to draw: histograms, bars, one trend, one scatter, cut to ``limit``.

    Reads only tables of one row per column or pair.
    """
    charts = []
    skew = {r["column"]: r["skewed"] for r in skewed(summary).select("column", "skewed").collect()}
    for c in columns_of(types, NUMERIC)[: max(1, min(3, limit))]:
        if c in skew:
            note = "Skewed distribution likely" if skew[c] else ""
            charts.append(("histogram", f"Distribution of {c}", [c], f"Histogram for numeric column '{c}'.", note))
    bars = [c for c in columns_of(types, CATEGORICAL, BOOLEAN)[: max(1, min(2, limit - len(charts)))] if c in df.columns]
    if bars:
        filled = df.agg(*[F.count(C.col(c)).alias(f"n{i}") for i, c in enumerate(bars)]).first()
        for i, c in enumerate(bars):
            if filled[f"n{i}"]:
                charts.append(("bar", f"Top values for {c}", [c], f"Category frequency chart for '{c}'.", ""))
    trend = trends.first()
    if trend and len(charts) < limit:
        d, v = trend["date_column"], trend["value_column"]
        note = f"R² = {trend['r_squared']:.2f}"
        charts.append(("line", f"Trend: {v} by {d}", [d, v], f"Time-series trend for '{v}' over '{d}'.", note))
    pair = correlations.first()
    if pair and len(charts) < limit:
        a, b = pair["column_a"], pair["column_b"]
        note = f"Correlation = {pair['correlation']:.2f}"
        charts.append(
            ("scatter", f"Scatter: {a} vs {b}", [a, b], "Scatter plot for the strongest numeric correlation pair.", note)
        )
    rows = [(i, *c) for i, c in enumerate(charts[: max(0, limit)])]
    return local_frame(df.sparkSession, rows, CHART_SCHEMA)
