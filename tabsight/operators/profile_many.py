"""Profiles of many tables of one schema at once.

The tables are one frame with a column that names the table. All facts are keyed by (dataset, column) from the start, the
type rules are column expressions, so that the number of jobs does not grow with the tables, and a table that holds a
third of all rows is spread over tasks like any other: every sum is combined before it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabsight.config import DATE, NUMERIC, ROW, field_names
from tabsight.functions import cells as C
from tabsight.operators.order_stats import MEDIAN, SMALL_GROUP, order_statistics
from tabsight.operators.profile import PROFILE_SCHEMA, top_ranked, with_types
from tabsight.sources.local import local_frame
from tabsight.sources.staging import cut_lineage, data_columns, ensure_rows

_TOP = 5
_SHORT_TEXT = 64


def _cells(df: DataFrame, dataset: str, columns: list[str], strict_numbers: bool) -> DataFrame:
    """(dataset, slot, _row, text, present, num, ts, flag, length, value) per cell; columns of one type are unpivoted together."""
    groups: dict[str, list[int]] = {}
    for i, kind in enumerate(C.kinds(df, columns).values()):
        groups.setdefault(kind, []).append(i)
    key, parts = C.col(dataset).cast("string").alias("dataset"), []
    for kind, slots in groups.items():
        wide = df.select(key, ROW, *[C.col(columns[i]).alias(f"_c{i}") for i in slots])
        raw = F.col("raw")
        present = ~C.is_missing(raw, kind)
        text = C.text_of(raw, kind)
        folded = C.fold_value(raw, kind)
        value = F.when(F.octet_length(folded) > _SHORT_TEXT, F.concat(F.lit("#"), F.sha2(folded, 256))).otherwise(folded)
        parts.append(
            wide.unpivot(["dataset", ROW], [f"_c{i}" for i in slots], "slot", "raw").select(
                "dataset", "slot", ROW, text.alias("text"), present.alias("present"),
                C.parse_number(raw, kind, strict_numbers).alias("num"), C.parse_date(raw, kind).alias("ts"),
                C.parse_boolean(raw, kind).alias("flag"),
                # Of typed cells no text is long.
                (F.when(present, F.length(C.strip(raw))) if kind == "string" else F.lit(0)).alias("length"),
                F.when(present, value).alias("value"), F.when(present, folded).alias("folded"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def profile_datasets(
    df: DataFrame, dataset: str, columns: list[str] | None = None, strict_numbers: bool = False, small_group: int = SMALL_GROUP
) -> DataFrame:
    """``dataset`` and the record of ``profile`` for each of its columns, over all rows of all tables.

    Tables are told apart by the text of the column ``dataset``; rows where it is null are a table named by null's text,
    ''. Numbers and ties follow the row order of the whole frame. Medians are searched for all (dataset, column) together;
    the bounds of so many groups are the only thing that reaches the driver.
    """
    df = ensure_rows(df)
    df = df.withColumn(dataset, F.coalesce(C.col(dataset).cast("string"), F.lit("")))
    columns = columns or [c for c in data_columns(df) if c != dataset]
    cells = _cells(df, dataset, columns, strict_numbers)
    keys = ["dataset", "slot"]

    counts = cells.filter("present").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"))
    counts = cut_lineage(counts)
    distinct = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_count"))
    facts = cells.groupBy(*keys).agg(
        F.count_if("present").alias("m"), F.count_if(~F.col("present")).alias("missing_count"),
        F.count("flag").alias("n_bool"), F.count("num").alias("n_num"), F.count("ts").alias("n_date"), F.avg("length").alias("avg_length"),
        F.min("num").alias("low"), F.max("num").alias("high"), F.avg("num").alias("mean"), F.stddev_samp("num").alias("sd"),
        F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"),
    )
    typed = cut_lineage(with_types(facts.join(distinct, keys, "left").na.fill(0, ["distinct_count"])))

    order = W.partitionBy(*keys).orderBy(ROW)
    first = cells.filter("present").select(*keys, ROW).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= _TOP)
    top = top_ranked(counts, keys, _TOP).select(*keys, F.col("first").alias(ROW), "rank", "n")
    # As many rows as ten times the columns of all tables, matched with the cells that they name.
    wanted = first.withColumn("n", F.lit(None).cast("long")).unionByName(top)
    shown = cells.select(*keys, ROW, "text", "folded").join(wanted, [*keys, ROW])
    listed = shown.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("n").isNull(), F.struct("rank", "text")))).alias("samples"),
        F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("rank", "folded", "n")))).alias("top"),
    )

    medians = _medians(cells, typed, small_group)
    whole = typed.join(listed, keys, "left").join(medians, keys, "left")
    position = F.substring("slot", 3, 6).cast("int")
    numeric, date = F.col("detected_type") == NUMERIC, F.col("detected_type") == DATE
    names = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (f"_c{i}", c)])
    no_top = F.array().cast("array<struct<value:string,count:long>>")
    return whole.select(
        "dataset", names[F.col("slot")].alias("column"), position.alias("position"), "detected_type", "confidence",
        F.col("m").alias("non_missing_count"), "missing_count", "distinct_count", "invalid_count",
        F.coalesce(F.transform("samples", lambda s: s["text"]), F.array().cast("array<string>")).alias("sample_values"),
        F.coalesce(F.transform("top", lambda t: F.struct(t["folded"].alias("value"), t["n"].alias("count"))), no_top).alias("top_values"),
        *[F.when(numeric, F.col(c)).alias(f"numeric_{n}") for n, c in (("min", "low"), ("max", "high"), ("mean", "mean"), ("median", "median"), ("stddev", "sd"))],
        *[F.when(date, C.iso_text(F.col(c))).alias(n) for n, c in (("date_min", "ts_min"), ("date_max", "ts_max"))],
    ).select("dataset", *field_names(PROFILE_SCHEMA))


def _medians(cells: DataFrame, typed: DataFrame, small_group: int) -> DataFrame:
    numeric = typed.filter(F.col("detected_type") == NUMERIC)
    bounds = numeric.select("dataset", "slot", F.col("n_num").alias("n"), "low", "high").collect()
    found = order_statistics(cells.select("dataset", "slot", "num"), ["dataset", "slot"], "num", {"median": MEDIAN}, bounds, small_group)
    rows = [(dataset, slot, stats["median"]) for (dataset, slot), stats in found.items()]
    return local_frame(cells.sparkSession, rows, "dataset string, slot string, median double")
