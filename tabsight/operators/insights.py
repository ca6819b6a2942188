"""Insight rules over report tables, for any number of datasets at once.

Every rule is a small frame of (dataset, section, place, text). Ranks are taken
per dataset, so one job writes the insights of all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabsight.operators.quality import with_dataset

DRIVERS, RISKS, ACTIONS = "key_drivers", "risks", "recommended_actions"

# Report texts and thresholds.
EMPTY_SUMMARY = "The uploaded CSV contains no data rows, so no statistical insights can be generated."
EMPTY_RISK = "The file is empty or only contains a header row."
EMPTY_ACTION = "Provide at least one populated data row and rerun the pipeline."
FLAT = "No strong correlations or trends crossed the reporting threshold, so the data appears relatively flat."
SMALL = "The dataset is very small, so correlations and models may be unstable."
SINGLE = "Single-column inputs limit correlation and segmentation analysis."
STANDING_ACTIONS = (
    "Review the top missing-value columns and choose a fill strategy that matches the business meaning of each field.",
    "Validate the outlier rows against source systems before treating them as true anomalies.",
    "Promote the strongest correlated dimensions into monitored KPIs or downstream feature engineering.",
)
WEAK_MODEL = "Treat the current predictive model as exploratory only; more features or more rows may be needed."
MORE_HISTORY = "Collect more history before relying on trend or regression output for decisions."
SOURCE_CHECKS = "Add source-side validation to prevent malformed or duplicate rows from entering the pipeline."
PAIR = "%s and %s move together with correlation %.2f across %d paired observations."
TREND = "%s shows a %s trend over %s with R² of %.2f."
MODEL = "Basic regression on %s explains %.2f of observed variance using %d feature(s)."
GAPS = "Missing values are concentrated in %s; imputation or source cleanup is likely needed."
COPIES = "The dataset contains %d duplicate record(s)."
SPIKES = "Potential outliers were found in %s."
UNSURE = "Schema confidence is weak for %s, so those columns should be reviewed manually."
MALFORMED = "%d malformed row(s) were repaired or truncated during ingestion."
SUMMARY = (
    "Processed %s row(s) across %d column(s). The quality report found %s missing cell(s), "
    "%s duplicate record(s), and %s potential outlier(s). Strongest analytical signals include %s."
)
STRONG_CORRELATION = 0.7
LOW_CONFIDENCE = 0.65


def _rule(df: DataFrame, section: str, place, text) -> DataFrame:
    place = place if isinstance(place, Column) else F.lit(place)
    text = text if isinstance(text, Column) else F.lit(text)
    return df.select("dataset", F.lit(section).alias("section"), place.cast("int").alias("place"), text.alias("text"))


def _ranked(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(W.partitionBy("dataset").orderBy(*order)))


def _named(df: DataFrame, template: str) -> DataFrame:
    """One row per dataset: the ranked column names joined into the template."""
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "column"))), lambda x: x["column"]), ", ")
    return df.groupBy("dataset").agg(names.alias("names")).select("dataset", F.format_string(template, "names").alias("line"))


def insights(
    quality: DataFrame,
    profile: DataFrame,
    outliers: DataFrame,
    correlations: DataFrame,
    trends: DataFrame,
    model: DataFrame,
) -> DataFrame:
    """(dataset, executive_summary, key_drivers, risks, recommended_actions)."""
    totals, columns = with_dataset(quality), with_dataset(profile)
    pairs, lines, fits = with_dataset(correlations), with_dataset(trends), with_dataset(model)
    found = with_dataset(outliers)
    if "outlier_count" not in found.columns:
        found = found.groupBy("dataset", "column").agg(F.count(F.lit(1)).alias("outlier_count"))
    place_of = columns.select("dataset", "column", "position")

    def placed(df: DataFrame, name: str, alias: str) -> DataFrame:
        keyed = place_of.select("dataset", F.col("column").alias(name), F.col("position").alias(alias))
        return df.join(keyed, ["dataset", name], "left")

    rules = []
    strong = pairs.filter((F.abs("correlation") >= STRONG_CORRELATION) & (F.col("pair_count") >= 3))
    strong = placed(placed(strong, "column_a", "_pa"), "column_b", "_pb")
    top_pairs = _ranked(strong, F.desc(F.abs("correlation")), "_pa", "_pb").filter(F.col("_rank") <= 3)
    rules.append(
        _rule(
            top_pairs, DRIVERS, F.col("_rank"),
            F.format_string(PAIR, "column_a", "column_b", "correlation", "pair_count"),
        )
    )
    first_trend = _ranked(placed(placed(lines, "date_column", "_pd"), "value_column", "_pv"), "_pd", "_pv")
    direction = F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    rules.append(
        _rule(
            first_trend.filter((F.col("_rank") == 1) & (F.abs("slope") > 0)), DRIVERS, 10,
            F.format_string(TREND, F.col("value_column"), direction, F.col("date_column"), F.col("r_squared")),
        )
    )
    r2 = F.try_element_at("metrics", F.lit("r_squared"))
    fits = fits.withColumn("r2", r2).filter(F.col("r2").isNotNull())
    rules.append(
        _rule(
            fits, DRIVERS, 20,
            F.format_string(MODEL, F.col("target_column"), F.col("r2"), F.size("feature_columns")),
        )
    )
    drivers = reduce(DataFrame.unionByName, rules)
    flat = _rule(totals.join(drivers.select("dataset").distinct(), "dataset", "left_anti"), DRIVERS, 30, FLAT)

    gaps = _ranked(columns.filter(F.col("missing_count") > 0), F.desc("missing_count"), "position").filter("_rank <= 3")
    spikes = _ranked(placed(found, "column", "position"), F.desc("outlier_count"), "position").filter("_rank <= 3")
    unsure = columns.filter((F.col("confidence") < LOW_CONFIDENCE) & (F.col("non_missing_count") > 0))
    unsure = _ranked(unsure, "position").filter("_rank <= 3")
    rows, bad, copies = F.col("row_count"), F.col("malformed_row_count"), F.col("duplicate_row_count")

    risks = [
        _rule(_named(gaps, GAPS), RISKS, 1, F.col("line")),
        _rule(totals.filter(copies > 0), RISKS, 2, F.format_string(COPIES, copies)),
        _rule(_named(spikes, SPIKES), RISKS, 3, F.col("line")),
        _rule(_named(unsure, UNSURE), RISKS, 4, F.col("line")),
        _rule(totals.filter(bad > 0), RISKS, 5, F.format_string(MALFORMED, bad)),
        _rule(totals.filter(rows < 10), RISKS, 6, SMALL),
        _rule(totals.filter(F.col("column_count") == 1), RISKS, 7, SINGLE),
    ]
    actions = [_rule(totals, ACTIONS, i + 1, text) for i, text in enumerate(STANDING_ACTIONS)] + [
        _rule(fits.filter(F.col("r2") < 0.4), ACTIONS, 4, WEAK_MODEL),
        _rule(totals.filter(rows < 50), ACTIONS, 5, MORE_HISTORY),
        _rule(totals.filter((bad > 0) | (copies > 0)), ACTIONS, 6, SOURCE_CHECKS),
    ]
    # A dozen texts per dataset at most.
    texts = reduce(DataFrame.unionByName, [drivers, flat, *risks, *actions])

    def listed(section: str) -> Column:
        kept = F.collect_list(F.when(F.col("section") == section, F.struct("place", "text")))
        return F.transform(F.sort_array(kept), lambda x: x["text"]).alias(section)

    gathered = texts.groupBy("dataset").agg(*[listed(s) for s in (DRIVERS, RISKS, ACTIONS)])
    hits = found.groupBy("dataset").agg(F.sum("outlier_count").alias("_outliers"))

    def counted(c) -> Column:
        return F.format_number(c, 0)

    report = totals.join(gathered, "dataset").join(hits, "dataset", "left")
    summary = F.format_string(
        SUMMARY, counted(rows), F.col("column_count"), counted(F.col("missing_cell_count")), counted(copies),
        counted(F.coalesce("_outliers", F.lit(0))), F.element_at(DRIVERS, 1),
    )
    empty, none = rows == 0, F.array().cast("array<string>")
    return report.select(
        "dataset",
        F.when(empty, EMPTY_SUMMARY).otherwise(summary).alias("executive_summary"),
        F.when(empty, none).otherwise(F.col(DRIVERS)).alias(DRIVERS),
        F.when(empty, F.array(F.lit(EMPTY_RISK))).otherwise(F.col(RISKS)).alias(RISKS),
        F.when(empty, F.array(F.lit(EMPTY_ACTION))).otherwise(F.col(ACTIONS)).alias(ACTIONS),
    )
