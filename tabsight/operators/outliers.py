"""Outliers by interquartile range and z-score."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.config import NUMERIC, ROW, field_names
from tabsight.operators.order_stats import SMALL_GROUP, column_order_statistics, linear
from tabsight.operators.profile import columns_of
from tabsight.operators.stats import column_stats, numeric_exprs
from tabsight.sources.local import local_frame
from tabsight.sources.staging import ensure_rows

OUTLIER_SCHEMA = (
    "column string, row_number long, value double, method string, score double, "
    "lower_bound double, upper_bound double"
)


def outliers(
    df: DataFrame,
    types: dict[str, str],
    iqr_multiplier: float = 1.5,
    zscore_threshold: float = 3.0,
    columns: list[str] | None = None,
    strict_numbers: bool = False,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Outlying cells of the NUMERIC columns with at least four numbers.

    The bounds are a few numbers per column and become literals, so flagging is
    one shuffle-free pass and only flagged cells are ever made into rows.
    """
    df = ensure_rows(df)
    exprs = numeric_exprs(df, columns or columns_of(types, NUMERIC), strict_numbers)
    stats = [s for s in column_stats(df, exprs) if s["n"] >= 4] if exprs else []
    if not stats:
        return local_frame(df.sparkSession, [], OUTLIER_SCHEMA)

    wanted = {"q1": linear(0.25), "q3": linear(0.75)}
    chosen = {s["column"]: exprs[s["column"]] for s in stats}
    quartiles = column_order_statistics(df, chosen, wanted, stats, small_group)

    wide = df.select(ROW, *[exprs[s["column"]].alias(f"_x{i}") for i, s in enumerate(stats)])
    flagged = []
    for i, s in enumerate(stats):
        q1, q3 = (quartiles[s["column"]][q] for q in ("q1", "q3"))
        lower, upper = q1 - iqr_multiplier * (q3 - q1), q3 + iqr_multiplier * (q3 - q1)
        x = F.col(f"_x{i}")
        beyond = F.lit(False) if math.isnan(lower) else (x < lower) | (x > upper)
        if s["low"] == s["high"] or not s["sd"] or math.isnan(s["sd"]):
            score, far = F.lit(0.0), F.lit(False)
        else:
            score = F.abs((x - s["mean"]) / s["sd"])
            far = score >= zscore_threshold
        method = F.when(beyond & far, "both").when(beyond, "iqr").otherwise("zscore")
        # A mean of zero counts as absent, which leaves the distance at zero.
        distance = F.abs(x - s["mean"]) if s["mean"] else F.lit(0.0)
        record = F.struct(
            F.lit(s["column"]).alias("column"),
            x.alias("value"),
            method.alias("method"),
            F.when(far, score).otherwise(distance).alias("score"),
            F.lit(lower).alias("lower_bound"),
            F.lit(upper).alias("upper_bound"),
        )
        flagged.append(F.when(x.isNotNull() & (beyond | far), record))
    hits = wide.select(F.col(ROW).alias("row_number"), F.explode(F.array_compact(F.array(*flagged))).alias("_hit"))
    return hits.select("row_number", "_hit.*").select(*field_names(OUTLIER_SCHEMA))
