"""Small driver-side tables as local relations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A frame of a few rows; handed over as Arrow it plans as a local scan and needs no tasks."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [() for _ in arrow]
    arrays = [
        pa.array([_entries(v) if pa.types.is_map(f.type) else v for v in values], type=f.type)
        for f, values in zip(arrow, columns)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def _entries(value):
    return None if value is None else list(value.items())


def hold(df: DataFrame) -> DataFrame:
    """Run a frame of a few rows once and keep its result."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
