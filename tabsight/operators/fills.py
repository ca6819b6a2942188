"""Forward and back fill in row order, distributed.

Rows go in buckets of consecutive row numbers, buckets in as large groups. One
small aggregate finds the last (first) value of each bucket, one of those finds
that of each group. A running scan over the groups, one row for some 7 * 10**10
rows, says what enters each group from outside, one over each group's buckets
what enters a bucket, and inside a bucket an ordinary window does the rest. No
window ever spans the table or all its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabsight.config import ROW

BUCKET_ROWS = 262_144


def fill_columns(
    df: DataFrame,
    above: dict[str, Column] | None = None,
    below: dict[str, Column] | None = None,
    bucket_rows: int = BUCKET_ROWS,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Add columns that carry a value over rows; with ``partition_by``, over the rows of equal keys only.

    ``above`` maps a new column to an expression whose last non-NULL value in
    the rows *before* the current one is taken; ``below`` to one whose first
    non-NULL value in the current row and the rows *after* it is taken.
    Expressions may be structs, so that "a cell was there but held no value"
    differs from "no cell".
    """
    above, below = above or {}, below or {}
    names = [*above, *below]
    if partition_by:
        return _fill_by_key(df, above, below, bucket_rows, partition_by)
    staged = df.withColumn("_bucket", F.floor(F.col(ROW) / bucket_rows))
    staged = staged.withColumns({f"_src_{n}": e for n, e in {**above, **below}.items()})

    def edge(name: str) -> Column:
        source = F.col(f"_src_{name}")
        # Wrapped, so that a struct holding NULL still counts as a value.
        order = F.when(source.isNotNull(), F.col(ROW))
        picked = F.max_by(source, order) if name in above else F.min_by(source, order)
        return picked.alias(name)

    edges = staged.groupBy("_bucket").agg(*[edge(n) for n in names])
    edges = edges.withColumn("_group", F.floor(F.col("_bucket") / bucket_rows))
    # "Below" is "above" in reverse order: frames that grow from their start cost one
    # step per row, frames that shrink towards their end would restart at every row.
    past = (W.unboundedPreceding, -1)

    def entering(key: str, groups) -> dict[str, Column]:
        earlier, later = groups.orderBy(key).rowsBetween(*past), groups.orderBy(F.desc(key)).rowsBetween(*past)
        return {n: F.last(n, ignorenulls=True).over(earlier if n in above else later) for n in names}

    ends = {n: F.when(F.col(n).isNotNull(), F.col("_bucket")) for n in names}
    groups = edges.groupBy("_group").agg(*[(F.max_by if n in above else F.min_by)(n, ends[n]).alias(n) for n in names])
    outer = groups.select("_group", *[e.alias(f"_out_{n}") for n, e in entering("_group", W).items()])
    inner = edges.select("_group", "_bucket", *[e.alias(f"_in_{n}") for n, e in entering("_bucket", W.partitionBy("_group")).items()])
    carried = inner.join(outer, "_group").select("_bucket", *[F.coalesce(f"_in_{n}", f"_out_{n}").alias(f"_in_{n}") for n in names])
    bucket = W.partitionBy("_bucket")
    before = bucket.orderBy(ROW).rowsBetween(*past)
    onward = bucket.orderBy(F.desc(ROW)).rowsBetween(W.unboundedPreceding, 0)
    local = {n: F.last(f"_src_{n}", ignorenulls=True).over(before) for n in above}
    local |= {n: F.last(f"_src_{n}", ignorenulls=True).over(onward) for n in below}
    # Both sides hash by bucket, so the join adds no shuffle of the rows.
    filled = staged.withColumns({f"_near_{n}": e for n, e in local.items()}).join(carried, "_bucket")
    return filled.select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in df.columns],
        *[F.coalesce(f"_near_{n}", f"_in_{n}").alias(n) for n in names],
    )


def _fill_by_key(df: DataFrame, above: dict[str, Column], below: dict[str, Column], bucket_rows: int, keys: list[str]) -> DataFrame:
    """Fills within keys (nulls are a key of their own).

    A key of up to ``bucket_rows`` rows is one window. Larger ones, of which there are as many as buckets in the table at
    the most, are cut by row number into segments (key, bucket), which are spread like other keys; what enters a
    segment comes from a running scan over the edges of that key's segments.
    """
    names = [*above, *below]
    staged = df.withColumn("_key", F.struct(*[F.col("`" + k.replace("`", "``") + "`").alias(f"k{i}") for i, k in enumerate(keys)]))
    staged = staged.withColumns({f"_src_{n}": e for n, e in {**above, **below}.items()})
    large = staged.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bucket_rows).select("_key", F.lit(True).alias("_large"))
    bucket = F.when(F.col("_large"), F.floor(F.col(ROW) / bucket_rows)).otherwise(F.lit(0).cast("long"))
    staged = staged.join(large, "_key", "left").withColumn("_bucket", bucket)

    def edge(name: str) -> Column:
        source = F.col(f"_src_{name}")
        order = F.when(source.isNotNull(), F.col(ROW))
        return (F.max_by if name in above else F.min_by)(source, order).alias(f"_in_{name}")

    past = (W.unboundedPreceding, -1)
    of_key = W.partitionBy("_key")
    earlier, later = of_key.orderBy("_bucket").rowsBetween(*past), of_key.orderBy(F.desc("_bucket")).rowsBetween(*past)
    edges = staged.filter("_large").groupBy("_key", "_bucket").agg(*[edge(n) for n in names])
    entering = [F.last(f"_in_{n}", ignorenulls=True).over(earlier if n in above else later).alias(f"_in_{n}") for n in names]
    carried = edges.select("_key", "_bucket", *entering)
    segment = W.partitionBy("_key", "_bucket")
    before, onward = segment.orderBy(ROW).rowsBetween(*past), segment.orderBy(F.desc(ROW)).rowsBetween(W.unboundedPreceding, 0)
    local = {f"_near_{n}": F.last(f"_src_{n}", ignorenulls=True).over(before if n in above else onward) for n in names}
    filled = staged.withColumns(local).join(carried, ["_key", "_bucket"], "left")
    return filled.select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], *[F.coalesce(f"_near_{n}", f"_in_{n}").alias(n) for n in names]
    )
