"""Sinks: report tables and cleaned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.cells import col, iso_text


def to_report_value(c: Column) -> Column:
    """JSON text of a value with NULL fields kept and ISO 8601 times."""
    return F.to_json(c, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"})


def report_rows(df: DataFrame) -> DataFrame:
    """Times as ISO text; everything else as it is."""
    times = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.DateType))}
    return df.select(*[iso_text(col(c).cast("timestamp")).alias(c) if c in times else col(c) for c in df.columns])


def write_table(df: DataFrame, path: str, format: str = "json") -> str:
    writer = df.write.mode("overwrite")
    if format == "json":
        report_rows(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        writer.format(format).save(path)
    return path


def write_reports(tables: dict[str, DataFrame], directory: str, format: str = "json") -> dict[str, str]:
    """Write each report table to its own directory; returns name to path."""
    base = str(directory).rstrip("/")
    return {name: write_table(df, f"{base}/{name}", format) for name, df in tables.items()}
