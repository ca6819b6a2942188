"""The whole run: scan, validate, clean, slice, analyze, chart data, insights, reports."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tabsight.config import WARNING, Config
from tabsight.functions.filters import slice_rows
from tabsight.operators.charts import chart_plan, histogram, scatter_points, trend_series, value_counts
from tabsight.operators.cleaning import clean
from tabsight.operators.insights import insights
from tabsight.operators.model import MODEL_SCHEMA, SingularModel, model
from tabsight.operators.outliers import outliers
from tabsight.operators.profile import column_types, profile
from tabsight.operators.quality import findings, quality, with_dataset
from tabsight.operators.stats import correlations, segments, summary
from tabsight.operators.trend import anomaly_findings, fit_trends, trend_anomalies, trends
from tabsight.sources.csv import SourceError, scan_csv
from tabsight.sources.local import hold, local_frame
from tabsight.sources.reports import write_reports, write_table
from tabsight.sources.staging import data_columns, ensure_rows, prepare_session, shared_folder

TIMING_SCHEMA = "stage string, duration_seconds double, status string, message string"


@dataclass
class RunResult:
    success: bool = False
    source_name: str = ""
    types: dict[str, str] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    timings: list[tuple] = field(default_factory=list)
    output_paths: dict[str, str] = field(default_factory=dict)
    persisted: list[DataFrame] = field(default_factory=list, repr=False)

    @property
    def cleaned(self) -> DataFrame | None:
        return self.tables.get("cleaned")

    def close(self) -> None:
        """Release what a run without a sink keeps persisted; its tables then run anew when they are read."""
        while self.persisted:
            self.persisted.pop().unpersist()


class _Run:
    def __init__(self, spark: SparkSession, config: Config, source_name: str) -> None:
        self.spark, self.config = spark, config
        self.result = RunResult(source_name=source_name)

    def stage(self, name: str, work: Callable[[], None]) -> None:
        start = time.perf_counter()
        try:
            work()
        except Exception as exc:
            self.result.timings.append((name, time.perf_counter() - start, "error", str(exc)))
            raise
        self.result.timings.append((name, time.perf_counter() - start, "ok", None))

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Cut a frame many stages read: a written table, or persisted where no sink is named."""
        if self.config.output_directory:
            path = write_table(df, f"{self.config.output_directory.rstrip('/')}/{name}", "parquet")
            self.result.output_paths[name] = path
            return self.spark.read.parquet(path)
        df = df.persist()
        self.result.persisted.append(df)
        return df


def analyze(df: DataFrame, types: dict[str, str], config: Config = Config()) -> tuple[dict[str, DataFrame], list[str]]:
    """Every analysis of a table by name, and warnings; runs alone on any frame, given the types of its columns.

    Trends, one row for each pair of a date and a value column, are computed once
    here: their anomaly counts scan all rows, and charts, insights and reports
    read them.
    """
    rows, warnings = ensure_rows(df), []
    fits = fit_trends(rows, types)
    anomalies = trend_anomalies(rows, types, fits, config.outlier_zscore_threshold)
    tables = {
        "summary": summary(rows, types),
        "correlations": correlations(rows, types),
        "segments": segments(rows, types),
        "trends": hold(trends(rows, types, config.outlier_zscore_threshold, fits=fits)),
        "trend_anomalies": anomalies,
        "anomaly_findings": anomaly_findings(anomalies),
    }
    try:
        tables["model"] = model(rows, types, config)
    except SingularModel as exc:
        tables["model"] = local_frame(df.sparkSession, [], MODEL_SCHEMA)
        warnings.append(f"No regression model: {exc}.")
    return tables, warnings


def run(spark: SparkSession, source, config: Config = Config(), source_name: str | None = None) -> RunResult:
    """Run every stage over a CSV path or a DataFrame; failures end up in ``errors``.

    With ``output_directory`` set, the numbered input and the cleaned rows are
    written once as Parquet and read back column by column by the later stages.
    """
    prepare_session(spark)
    is_table = isinstance(source, DataFrame)
    name = source_name or ("table" if is_table else str(source).rstrip("/").rsplit("/", 1)[-1])
    job = _Run(spark, config, name)
    result, tables = job.result, job.result.tables
    state: dict = {}

    def ingest() -> None:
        if is_table:
            state["rows"], state["malformed"] = job.keep("input", ensure_rows(source)), None
            return
        scan = scan_csv(spark, source, config)
        state["rows"], state["malformed"] = job.keep("input", scan.rows), job.keep("malformed", scan.malformed)
        tables["malformed"], tables["ingest_findings"], tables["audit"] = state["malformed"], scan.findings, scan.audit
        result.warnings += [r["message"] for r in scan.findings.collect() if r["severity"] == WARNING]

    def validate() -> None:
        nonlocal tables
        rows = state["rows"]
        columns = data_columns(rows)
        found = profile(rows, columns, config.sample_rows_for_inference, config.strict_numbers)
        state["types"] = result.types = column_types(found)
        counters = quality(rows, state["malformed"], columns)
        counters = hold(counters)
        flagged = outliers(
            rows, state["types"], config.outlier_iqr_multiplier, config.outlier_zscore_threshold,
            strict_numbers=config.strict_numbers,
        )
        if config.output_directory:
            flagged = job.keep("outliers", flagged)
        totals = flagged.groupBy("column").count().withColumnRenamed("count", "outlier_count")
        totals = hold(totals)
        tables |= {
            "profile": with_dataset(found, name),
            "quality": with_dataset(counters, name),
            "outliers": flagged,
            "issues": findings(with_dataset(found, name), with_dataset(counters, name), with_dataset(totals, name), config),
        }
        state["outlier_totals"] = with_dataset(totals, name)

    def tidy() -> None:
        cleaned = clean(state["rows"], state["types"], config)
        if config.output_directory:
            # Cells are parsed once; rows, log and counters come from what that wrote.
            cleaned = cleaned.written(f"{shared_folder(spark).rstrip('/')}/cleaning-{uuid.uuid4().hex}")
        state["cleaned"] = tables["cleaned"] = job.keep("cleaned", cleaned.rows)
        tables["change_log"] = cleaned.change_log
        tables["cleaning"] = hold(cleaned.report)
        state["sliced"] = slice_rows(state["cleaned"], config.slice_filters)
        if config.slice_filters:
            # Fixed text.
            result.warnings.append(
                f"Applied {len(config.slice_filters)} slice filter(s) before analysis and visualization."
            )

    def study() -> None:
        nonlocal tables
        found, warnings = analyze(state["sliced"], state["types"], config)
        tables |= found
        result.warnings += warnings

    def chart() -> None:
        rows = state["sliced"]
        plan = chart_plan(
            rows, state["types"], tables["summary"], tables["trends"], tables["correlations"], config.chart_limit
        )
        tables["chart_plan"] = plan
        points = config.chart_points
        makers = {
            "histogram": histogram,
            "bar": value_counts,
            "line": lambda *of: trend_series(*of, bucket="day" if points else None),
            "scatter": lambda *of: scatter_points(*of, max_points=points or None),
        }
        for r in plan.collect():
            tables[f"chart_{r['position']}_{r['kind']}"] = makers[r["kind"]](rows, *r["columns"])

    def explain() -> None:
        tables["insights"] = insights(
            tables["quality"],
            tables["profile"],
            state["outlier_totals"],
            *[with_dataset(tables[t], name) for t in ("correlations", "trends", "model")],
        )

    def report() -> None:
        if config.output_directory:
            pending = {n: t for n, t in tables.items() if n not in result.output_paths}
            result.output_paths |= write_reports(pending, config.output_directory)

    try:
        for stage, work in (
            ("ingestion", ingest), ("validation", validate), ("cleaning", tidy), ("analysis", study),
            ("visualization", chart), ("insights", explain), ("reporting", report),
        ):
            job.stage(stage, work)
        result.success = True
    except SourceError as exc:
        result.errors.append(str(exc))
    except Exception as exc:  # a run reports its failure instead of raising
        result.errors.append(f"{type(exc).__name__}: {exc}")
    if not result.success:
        result.close()
    _summarize(job)
    return result


def _summarize(job: _Run) -> None:
    """Run summary, written last so that it tells how the run ended."""
    result = job.result
    result.tables["timings"] = local_frame(job.spark, result.timings, TIMING_SCHEMA)
    result.tables["run_summary"] = local_frame(job.spark, [(result.success, result.source_name, result.errors, result.warnings, dict(result.output_paths))],
        "success boolean, source_name string, errors array<string>, warnings array<string>, "
        "output_paths map<string,string>",
    )
    if not job.config.output_directory:
        return
    try:
        if not result.success:
            partial = {n: t for n, t in result.tables.items() if n not in result.output_paths}
            result.output_paths |= write_reports(partial, job.config.output_directory)
        else:
            last = {n: result.tables[n] for n in ("timings", "run_summary")}
            result.output_paths |= write_reports(last, job.config.output_directory)
    except Exception as exc:
        result.warnings.append(f"Could not write every report: {exc}")
