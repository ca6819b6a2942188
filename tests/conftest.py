import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tabsight-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def numbered(spark):
    """Rows given as tuples to a text frame with ``_row`` from 2, spread over partitions."""

    def make(columns, rows, partitions=3):
        names = columns.split()
        data = [(i + 2, *r) for i, r in enumerate(rows)]
        schema = "_row long, " + ", ".join(f"`{n}` string" if ":" not in n else n.replace(":", " ") for n in names)
        return spark.createDataFrame(data, schema).repartition(partitions)

    return make
