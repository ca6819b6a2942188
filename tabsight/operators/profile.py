"""Column profiles: type detection, counts, top and sample values, ranges."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabsight.config import BOOLEAN, CATEGORICAL, DATE, FIRST_ROW, NUMERIC, ROW, TEXT, fields
from tabsight.functions import cells as C
from tabsight.operators.order_stats import MEDIAN, SMALL_GROUP, order_statistics
from tabsight.sources.local import local_frame
from tabsight.sources.staging import data_columns, ensure_rows, first_rows

PROFILE_SCHEMA = (
    "column string, position int, detected_type string, confidence double, non_missing_count long, "
    "missing_count long, distinct_count long, invalid_count long, sample_values array<string>, "
    "top_values array<struct<value:string,count:long>>, numeric_min double, numeric_max double, "
    "numeric_mean double, numeric_median double, numeric_stddev double, date_min string, date_max string"
)

_SHORT_TEXT = 64
_SAMPLES = 5
_LIKELY_ROWS = 1_000


def head_rows(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows by row number; all of them when ``rows <= 0``."""
    return df.filter(F.col(ROW) < rows + FIRST_ROW) if rows > 0 else df


def _by_kind(df: DataFrame, columns: list[str]) -> dict[str, list[int]]:
    groups: dict[str, list[int]] = {}
    for i, kind in enumerate(C.kinds(df, columns).values()):
        groups.setdefault(kind, []).append(i)
    return groups


def _unpivot(df: DataFrame, columns: list[str], slots: list[int], to=lambda c: c) -> DataFrame:
    """(_row, slot, raw) per cell of columns that share one type; the slot is ``_c`` and the position."""
    wide = df.select(ROW, *[to(C.col(columns[i])).alias(f"_c{i}") for i in slots])
    return wide.unpivot([ROW], [f"_c{i}" for i in slots], "slot", "raw")


def _position() -> Column:
    # Read from the slot name after aggregating, so once per group rather than once per cell.
    return F.substring("slot", 3, 6).cast("int").alias("position")


def _count_cells(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy("slot", *keys).agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"))


#: What a cell reads as: whether it holds something, its number, time and truth value, the length and the counting key of a text.
_READINGS = ("present", "num", "ts", "flag", "length", "value")


def _readings(kind: str, strict_numbers: bool) -> list[Column]:
    """``_READINGS`` of ``raw``, a cell as it is counted. Only texts have a key; other cells are counted by themselves."""
    raw = F.col("raw")
    if kind == "string":
        present = ~C.is_missing(raw)
        folded = C.fold_value(raw)
        # A digest has 65 characters and cannot meet an undigested key, which has at most 64 bytes.
        key = F.when(F.octet_length(folded) > _SHORT_TEXT, F.concat(F.lit("#"), F.sha2(folded, 256))).otherwise(folded)
        found = [
            present, C.parse_number(raw, strict=strict_numbers), C.parse_date(raw), C.parse_boolean(raw),
            F.when(present, F.length(C.strip(raw))), F.when(present, key),
        ]
    else:
        # The text of a typed value has at most 40 characters, all the rule asks of it.
        present = raw.isNotNull()
        number = raw.cast("double") if kind == "decimal" else C.parse_number(raw, kind)
        time = raw if kind == "temporal" else F.lit(None).cast("timestamp")
        flag = {"decimal": C.parse_boolean(raw), "boolean": raw == "True"}.get(kind, C.parse_boolean(raw, kind))
        found = [present, number, time, flag, F.when(present, F.lit(0)), F.lit(None).cast("string")]
    return [c.alias(name) for name, c in zip(_READINGS, found, strict=True)]


def cell_counts(df: DataFrame, columns: list[str], strict_numbers: bool = False) -> DataFrame:
    """(position, present, num, ts, flag, length, value, n, first) per distinct cell of every column.

    Cells are counted as they are, typed columns in their own type, and read afterwards, once for each distinct one. Long
    texts are read first, so that a digest is shuffled instead of the text.
    """
    shapes = {
        "string": lambda c: c.cast("string"),
        "integral": lambda c: c.cast("long"),
        "floating": lambda c: c.cast("double"),
        "temporal": lambda c: c.cast("timestamp"),
    }
    parts = []
    for kind, slots in _by_kind(df, columns).items():
        as_text = lambda c, kind=kind: C.text_of(c, kind)
        cells = _unpivot(df, columns, slots, shapes.get(kind, as_text))
        readings = _readings(kind, strict_numbers)
        if kind == "string":
            long = F.octet_length("raw") > _SHORT_TEXT
            parts.append(_count_cells(cells.filter(long).select(ROW, "slot", *readings), *_READINGS))
            cells = cells.filter(F.col("raw").isNull() | ~long)
        parts.append(_count_cells(cells, "raw").select("slot", *readings, "n", "first"))
    return reduce(DataFrame.unionByName, [part.select(_position(), *_READINGS, "n", "first") for part in parts])


def _facts(counts: DataFrame) -> dict[int, dict]:
    """Counts and ranges per column position, from the counted cells."""
    n = F.col("n")

    def cells(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    present, number = F.col("present"), F.col("num").isNotNull()
    facts = counts.groupBy("position").agg(
        cells(present).alias("m"), cells(~present).alias("missing_count"),
        cells(F.col("flag").isNotNull()).alias("n_bool"), cells(number).alias("n_num"), cells(F.col("ts").isNotNull()).alias("n_date"),
        F.try_divide(F.sum(F.col("length") * n), cells(present)).alias("avg_length"),
        F.min("num").alias("num_min"), F.max("num").alias("num_max"), F.count("num").alias("num_rows"),
        F.try_divide(F.sum(F.col("num") * n), cells(number)).alias("num_mean"),
        C.iso_text(F.min("ts")).alias("date_min"), C.iso_text(F.max("ts")).alias("date_max"),
    )
    return {r["position"]: r.asDict() for r in facts.collect()}


def top_ranked(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent values per key, ties to the first seen; adds ``rank``."""
    order = W.partitionBy(*keys).orderBy(F.desc("n"), F.asc("first"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _distinct_and_top(counts: DataFrame, has_texts: bool) -> dict[int, dict]:
    """Distinct counts and the five top values per column position."""

    def read(values: DataFrame) -> dict[int, dict]:
        found = {r["position"]: {"distinct_count": r["n"], "top": []} for r in values.groupBy("position").agg(F.count(F.lit(1)).alias("n")).collect()}
        for r in top_ranked(values, ["position"], _SAMPLES).orderBy("position", "rank").collect():
            found[r["position"]]["top"].append(r)
        return found

    found = read(counts.filter(F.col("present") & F.col("value").isNull()).select("position", "n", "first"))
    if has_texts:
        # Texts that differ in case and spaces are one value. Read apart: in a union the counted cells would be counted anew.
        texts = counts.filter(F.col("value").isNotNull()).groupBy("position", "value")
        texts = texts.agg(F.sum("n").alias("n"), F.min("first").alias("first")).drop("value").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found |= read(texts)
        finally:
            texts.unpersist()
    return found


def _samples(df: DataFrame, columns: list[str]) -> dict[int, list]:
    """The first five non-missing cells per column (their row numbers)."""
    by_kind = C.kinds(df, columns)

    def cell(i: int) -> Column:
        c, kind = C.col(columns[i]), by_kind[columns[i]]
        return F.when(~C.is_missing(c, kind), F.lit(""))

    wide = df.select(ROW, *[cell(i).alias(f"_c{i}") for i in range(len(columns))])
    long = wide.unpivot([ROW], [f"_c{i}" for i in range(len(columns))], "slot", "raw")
    present = long.filter(F.col("raw").isNotNull()).select("slot", ROW)
    order = W.partitionBy("slot").orderBy(ROW)
    first = present.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= _SAMPLES)
    found: dict[int, list] = {}
    for r in first.select(_position(), ROW).orderBy("position", ROW).collect():
        found.setdefault(r["position"], []).append(r)
    return found


# The share of a column's cells that have to read as a type, how many at least, and the count of those cells.
TYPE_SHARES = ((BOOLEAN, 0.9, 0, "n_bool"), (NUMERIC, 0.8, 3, "n_num"), (DATE, 0.8, 3, "n_date"))
# A column is categorical with so many distinct values, or that share of its cells, if its texts are no longer.
FEW_VALUES = ((20, 0.3, None), (50, 0.5, 40))


def with_types(facts: DataFrame) -> DataFrame:
    """Add ``detected_type``, ``confidence`` and ``invalid_count`` to facts of one row a column.

    Needs ``m`` (cells that hold something), ``distinct_count``, ``avg_length`` and the counts that ``TYPE_SHARES`` names;
    other columns pass through, so one frame may hold the columns of any number of tables.
    """
    m, distinct = F.col("m"), F.col("distinct_count")
    shares = {kind: F.col(count) / F.greatest(m, F.lit(1)) for kind, _, _, count in TYPE_SHARES}
    # Candidates from the last to the first, each over those after it.
    chosen = F.struct(F.lit(TEXT).alias("detected_type"), F.greatest(*shares.values()).alias("confidence"), F.lit(0).cast("long").alias("invalid_count"))
    limits = [(distinct <= F.greatest(F.lit(n), F.floor(m * share))) & (F.lit(True) if length is None else F.col("avg_length") <= length) for n, share, length in FEW_VALUES]
    spread = F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.lit(1.0) - distinct / F.greatest(m, F.lit(1)) + 0.5))
    few = F.struct(F.lit(CATEGORICAL).alias("detected_type"), spread.alias("confidence"), F.lit(0).cast("long").alias("invalid_count"))
    chosen = F.when(reduce(lambda a, b: a | b, limits), few).otherwise(chosen)
    for kind, share, least, count in reversed(TYPE_SHARES):
        fitting = F.struct(F.lit(kind).alias("detected_type"), shares[kind].alias("confidence"), (m - F.col(count)).alias("invalid_count"))
        chosen = F.when((shares[kind] >= share) & (F.col(count) >= least), fitting).otherwise(chosen)
    nothing = F.struct(F.lit(TEXT).alias("detected_type"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("invalid_count"))
    return facts.withColumn("_type", F.when(m == 0, nothing).otherwise(chosen)).select("*", "_type.*").drop("_type")


_RULE_SCHEMA = "position int, m long, distinct_count long, avg_length double, n_bool long, n_num long, n_date long"


def profile(
    df: DataFrame,
    columns: list[str] | None = None,
    sample_rows: int = 0,
    strict_numbers: bool = False,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """One record per column over all rows, or over the first ``sample_rows`` if that is above 0.

    ``small_group`` bounds the rows that one task sorts for a median; larger
    columns are narrowed by counting first, with the same result.

    Runs its jobs right away: what comes back is a local frame of one row per
    column, since every later stage chooses its plan by these types.
    """
    head = first_rows(df, sample_rows) if sample_rows > 0 else ensure_rows(df)
    columns = columns or data_columns(head)
    # The first rows nearly always hold five values of every column already.
    near = head_rows(head, min(_LIKELY_ROWS, sample_rows) if sample_rows > 0 else _LIKELY_ROWS)
    counts = cell_counts(head, columns, strict_numbers)
    # Read several times: fewer parts than the shuffles of all kinds of columns have, and a few for each core.
    spark = df.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 4 * spark.sparkContext.defaultParallelism))
    counts = counts.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Independent jobs with tiny results: run side by side, they fill each other's idle cores.
        with ThreadPoolExecutor(2) as pool:
            found, samples = pool.map(lambda job: job(), [lambda: _facts(counts), lambda: _samples(near, columns)])
        values = _distinct_and_top(counts, "string" in _by_kind(head, columns))
        for i, r in found.items():
            r |= values.get(i, {"distinct_count": 0, "top": []})
            r["samples"] = samples.get(i, [])
        names = [name for name, _ in fields(_RULE_SCHEMA)]
        facts = local_frame(df.sparkSession, [(i, *(r[n] for n in names[1:])) for i, r in found.items()], _RULE_SCHEMA)
        for r in with_types(facts).collect():
            found[r["position"]] |= {n: r[n] for n in ("detected_type", "confidence", "invalid_count")}
        numeric = {i: r for i, r in found.items() if r["detected_type"] == NUMERIC}
        medians = _medians(counts, numeric, small_group)
        _add_spreads(counts, head, columns, numeric, strict_numbers)
    finally:
        counts.unpersist()

    sparse = [i for i, r in found.items() if len(r["samples"]) < min(_SAMPLES, r["m"])]
    if sparse:
        late = _samples(head, [columns[i] for i in sparse])
        for slot, rows in late.items():
            found[sparse[slot]]["samples"] = rows
    texts = _texts_at(head, columns, found)

    records = [_record(name, i, found.get(i), medians.get(i), texts) for i, name in enumerate(columns)]
    return local_frame(df.sparkSession, records, PROFILE_SCHEMA)


def _medians(counts: DataFrame, numeric: dict[int, dict], small_group: int) -> dict[int, float]:
    bounds = [
        {"position": i, "n": r["n_num"], "rows": r["num_rows"], "low": r["num_min"], "high": r["num_max"]}
        for i, r in numeric.items()
    ]
    stats = order_statistics(counts, ["position"], "num", {"median": MEDIAN}, bounds, small_group, weight="n")
    return {i: found["median"] for (i,), found in stats.items()}


def _add_spreads(counts: DataFrame, head: DataFrame, columns: list[str], numeric: dict[int, dict], strict_numbers: bool) -> None:
    """Add ``num_stddev``: from the counted cells by their distances from the mean, from the cells where no double holds their sum."""
    by_kind = C.kinds(head, columns)
    means, wide = [], []
    for i, r in numeric.items():
        if math.isfinite(r["num_mean"]):
            means.append((i, r["num_mean"]))
        else:
            number = C.parse_number(C.col(columns[i]), by_kind[columns[i]], strict_numbers)
            wide.append(F.stddev_samp(number).alias(str(i)))
    if means:
        known = F.broadcast(local_frame(counts.sparkSession, means, "position int, mean double"))
        away = F.col("num") - F.col("mean")
        for r in counts.join(known, "position").groupBy("position").agg(F.sum(away * away * F.col("n")).alias("squares")).collect():
            n = numeric[r["position"]]["n_num"]
            numeric[r["position"]]["num_stddev"] = math.sqrt(r["squares"] / (n - 1)) if n > 1 else None
    if wide:
        for i, spread in head.agg(*wide).first().asDict().items():
            numeric[int(i)]["num_stddev"] = spread


def _texts_at(head: DataFrame, columns: list[str], found: dict) -> dict:
    """Texts and folded texts of the cells that top and sample values point to: at most ten for each column."""
    wanted = {(t["first"], i) for i, r in found.items() for t in r["top"]} | {(s[ROW], i) for i, r in found.items() for s in r["samples"]}
    if not wanted:
        return {}
    by_kind = C.kinds(head, columns)
    cells = [
        F.struct(F.lit(i).alias("position"), C.text_of(C.col(c), by_kind[c]).alias("text"), C.fold_value(C.col(c), by_kind[c]).alias("folded"))
        for i, c in enumerate(columns)
    ]
    rows = head.filter(F.col(ROW).isin(sorted({row for row, _ in wanted}))).select(ROW, F.explode(F.array(*cells)).alias("cell"))
    few = F.broadcast(local_frame(head.sparkSession, sorted(wanted), f"{ROW} long, position int"))
    some = rows.select(ROW, "cell.*").join(few, [ROW, "position"])
    return {(r["position"], r[ROW]): (r["text"], r["folded"]) for r in some.collect()}


def _record(name: str, position: int, row, median, texts: dict) -> tuple:
    if row is None:
        return (name, position, TEXT, 0.0, 0, 0, 0, 0, [], [], *[None] * 7)
    top = [(texts[position, t["first"]][1], t["n"]) for t in row["top"]]
    samples = [texts[position, s[ROW]][0] for s in row["samples"]]
    is_numeric = row["detected_type"] == NUMERIC
    is_date = row["detected_type"] == DATE
    numbers = [row["num_min"], row["num_max"], row["num_mean"], median, row.get("num_stddev")]
    return (
        name,
        position,
        row["detected_type"],
        row["confidence"],
        row["m"],
        row["missing_count"],
        row["distinct_count"],
        row["invalid_count"],
        samples,
        top,
        *(numbers if is_numeric else [None] * 5),
        row["date_min"] if is_date else None,
        row["date_max"] if is_date else None,
    )


def column_types(profile_df: DataFrame) -> dict[str, str]:
    """Column to detected type, in column order; one row per column is collected."""
    rows = profile_df.select("column", "position", "detected_type").collect()
    return {r["column"]: r["detected_type"] for r in sorted(rows, key=lambda r: r["position"])}


def columns_of(types: dict[str, str], *wanted: str) -> list[str]:
    return [c for c, t in types.items() if t in wanted]


#: Size of a sketch as a power of 2: with 2**16 registers estimates err by some 0.4 % (one standard deviation).
SKETCH_BITS = 16
#: Columns whose sketches are made in one scan, without a row for each of their cells.
_SIDE_BY_SIDE = 32
SKETCH_SCHEMA = "column string, position int, sketch binary, cells long"


def distinct_sketches(df: DataFrame, columns: list[str] | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """``column``, ``position``, ``sketch``, ``cells``: mergeable sketches of the distinct folded values, and how many
    values there are.

    For tables whose exact distinct count costs too much, and for those that grow: the sketches of new files are merged
    with those kept of the old ones (``merge_sketches``), and give the estimate of the whole. A task keeps one sketch a
    column; no value is shuffled.
    """
    columns = columns or data_columns(df)
    by_kind = C.kinds(df, columns)
    as_text = {"floating": lambda c: c.cast("double").cast("string"), "string": lambda c: F.when(~C.is_missing(c), C.fold_value(c))}
    values = [as_text.get(by_kind[c], lambda x, kind=by_kind[c]: C.text_of(x, kind))(C.col(c)) for c in columns]
    parts = []
    for start in range(0, len(columns), _SIDE_BY_SIDE):
        block = range(start, min(start + _SIDE_BY_SIDE, len(columns)))
        measures = [m for i in block for m in (F.hll_sketch_agg(f"_c{i}", bits).alias(f"sketch{i}"), F.count(f"_c{i}").alias(f"cells{i}"))]
        row = df.select(*[values[i].alias(f"_c{i}") for i in block]).agg(*measures)
        records = [F.struct(F.lit(columns[i]).alias("column"), F.lit(i).alias("position"), F.col(f"sketch{i}").alias("sketch"), F.col(f"cells{i}").alias("cells")) for i in block]
        parts.append(row.select(F.inline(F.array(*records))))
    return reduce(DataFrame.unionByName, parts)


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """Sketches of several parts of a table as those of the whole."""
    parts = reduce(DataFrame.unionByName, sketches)
    return parts.groupBy("column", "position").agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("cells").alias("cells"))


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """``column``, ``position``, ``distinct_estimate``; never more than there are values."""
    estimate = F.least(F.hll_sketch_estimate("sketch"), F.col("cells"))
    return sketches.select("column", "position", estimate.alias("distinct_estimate"))
