"""Summary statistics, correlations and segments."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.config import BOOLEAN, CATEGORICAL, NUMERIC, ROW
from tabsight.functions import cells as C
from tabsight.operators.order_stats import MEDIAN, SMALL_GROUP, column_order_statistics, floor_index, order_statistics
from tabsight.operators.profile import columns_of, top_ranked
from tabsight.sources.local import local_frame
from tabsight.sources.staging import ensure_rows

SUMMARY_SCHEMA = (
    "column string, count long, mean double, median double, stddev double, "
    "min double, q1 double, q3 double, max double"
)
CORRELATION_SCHEMA = "column_a string, column_b string, correlation double, pair_count long"

_BLOCK = 16
#: Columns of a block of product matrices, blocks that one sum meets, and pairs of one aggregate.
_MATRIX, _MET_BLOCKS, _AGAIN = 128, 64, 100


def numeric_exprs(df: DataFrame, columns: list[str], strict_numbers: bool = False) -> dict[str, Column]:
    """Column name to its number expression; an absent column reads as NULL."""
    present = [c for c in columns if c in df.columns]
    by_kind = C.kinds(df, present)
    return {c: C.parse_number(C.col(c), by_kind[c], strict_numbers) for c in present}


def column_stats(df: DataFrame, exprs: dict[str, Column]) -> list[dict]:
    """Count, mean, deviation and range per column from one scan.

    One aggregate without keys, so a partition ships one row; the columns of wide tables are unpivoted first, so that the
    generated code does not grow with them.
    """
    slots = {f"_x{i}": c for i, c in enumerate(exprs)}
    wide = df.select(*[e.alias(slot) for slot, e in zip(slots, exprs.values())])
    facts = {"n": "count({0})", "mean": "avg({0})", "sd": "stddev_samp({0})", "low": "min({0})", "high": "max({0})"}
    if len(slots) <= 4 * _BLOCK:
        aggregates = [f"{sql.format(slot)} AS {name}{slot}" for slot in slots for name, sql in facts.items()]
        row = wide.selectExpr("count(1) AS rows", *aggregates).first()
        return [{"column": c, "rows": row["rows"], **{name: row[f"{name}{slot}"] for name in facts}} for slot, c in slots.items()]
    long = wide.unpivot([], list(slots), "slot", "x").groupBy("slot")
    found = {r["slot"]: r for r in long.agg(F.count(F.lit(1)).alias("rows"), *[F.expr(sql.format("x")).alias(name) for name, sql in facts.items()]).collect()}
    empty = {"rows": 0, "n": 0, "mean": None, "sd": None, "low": None, "high": None}
    return [{"column": c, **(found[slot].asDict() if slot in found else empty)} for slot, c in slots.items()]


def summary(
    df: DataFrame,
    types: dict[str, str],
    columns: list[str] | None = None,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Summary statistics per NUMERIC column; quartiles take the floor index."""
    exprs = numeric_exprs(df, columns or columns_of(types, NUMERIC))
    stats = [s for s in column_stats(df, exprs) if s["n"]] if exprs else []
    quantiles = {}
    if stats:
        wanted = {"median": MEDIAN, "q1": floor_index(0.25), "q3": floor_index(0.75)}
        chosen = {s["column"]: exprs[s["column"]] for s in stats}
        quantiles = column_order_statistics(df, chosen, wanted, stats, small_group)
    rows = []
    for s in stats:
        q = quantiles[s["column"]]
        constant = s["low"] == s["high"]
        deviation = 0.0 if constant or s["sd"] is None else s["sd"]
        mean = s["low"] if constant else s["mean"]
        rows.append((s["column"], s["n"], mean, q["median"], deviation, s["low"], q["q1"], q["q3"], s["high"]))
    return local_frame(df.sparkSession, rows, SUMMARY_SCHEMA)


def correlations(df: DataFrame, types: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of NUMERIC columns on complete pairs.

    One pass finds means and constants, a second sums products of centered
    values: one sum per pair where neither column has gaps, more where the
    complete pairs differ from the columns. Tables of more columns than one
    aggregate holds sum matrices of products instead, still in one pass.
    """
    exprs = numeric_exprs(df, columns or columns_of(types, NUMERIC))
    stats = {s["column"]: s for s in column_stats(df, exprs)} if len(exprs) > 1 else {}
    names = [c for c in exprs if stats and stats[c]["n"] >= 2 and stats[c]["low"] != stats[c]["high"]]
    if len(names) <= _BLOCK:
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        rows = _summed_pairs(df, exprs, stats, pairs)
    else:
        rows = _wide_pairs(df, exprs, stats, names)
    position = {c: i for i, c in enumerate(exprs)}
    rows.sort(key=lambda r: (-abs(r[2]), position[r[0]], position[r[1]]))
    return local_frame(df.sparkSession, rows, CORRELATION_SCHEMA)


def _summed_pairs(df, exprs, stats, pairs: list[tuple[str, str]]) -> list[tuple]:
    """Correlations of some pairs from one aggregate."""
    if not pairs:
        return []
    used = list(dict.fromkeys(c for pair in pairs for c in pair))
    slot = {c: f"_x{i}" for i, c in enumerate(used)}
    centered = df.select(*[(exprs[c] - F.lit(stats[c]["mean"])).alias(slot[c]) for c in used])
    aggregates = []
    for k, (a, b) in enumerate(pairs):
        x, y = slot[a], slot[b]
        aggregates.append(f"sum({x} * {y}) AS xy{k}")
        if _gapless(stats[a]) and _gapless(stats[b]):
            continue
        px, py = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
        aggregates.append(f"count({x} * {y}) AS n{k}")
        for name, p in (("x", px), ("y", py)):
            aggregates += [
                f"sum({p}) AS {name}{k}", f"sum(power({p}, 2)) AS {name}{name}{k}",
                f"min({p}) AS {name}low{k}", f"max({p}) AS {name}high{k}",
            ]
    row = centered.selectExpr(*aggregates).first().asDict()
    results = []
    for k, (a, b) in enumerate(pairs):
        xy = row[f"xy{k}"]
        if f"n{k}" in row:
            n = row[f"n{k}"]
            if n < 2 or row[f"xlow{k}"] == row[f"xhigh{k}"] or row[f"ylow{k}"] == row[f"yhigh{k}"]:
                continue
            sx, sy = row[f"x{k}"], row[f"y{k}"]
            xy -= sx * sy / n
            xx, yy = row[f"xx{k}"] - sx * sx / n, row[f"yy{k}"] - sy * sy / n
        else:
            n = stats[a]["n"]
            xx, yy = (stats[c]["sd"] ** 2 * (n - 1) for c in (a, b))
        if xx > 0 and yy > 0:
            value = xy / (math.sqrt(xx) * math.sqrt(yy))
            if not math.isnan(value):
                results.append((a, b, value, n))
    return results


def _adder():
    """Sums blocks of equal keys. Built by value for the workers."""

    def add(rows):
        import numpy as np

        return rows.iloc[:1].assign(part=[np.sum([np.frombuffer(p) for p in rows["part"]], axis=0).tobytes()])

    return add


def _products(size: int):
    """Rows of centered columns to partial sums of every task, in blocks of columns. Built by value for the workers.

    A block (i, j) stacks four matrices over its columns a and b: sums of x_a x_b, of x_a and of x_a^2 where b is there,
    and how often both are.
    """

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            there = ~np.isnan(x)
            x[~there] = 0.0
            there = there.astype(np.float64)
            part = np.stack([x.T @ x, x.T @ there, (x * x).T @ there, there.T @ there])
            total = part if total is None else total + part
        if total is None:
            return
        starts = range(0, total.shape[1], size)
        cells = [(i, j, np.ascontiguousarray(total[:, a : a + size, b : b + size]).tobytes()) for i, a in enumerate(starts) for j, b in enumerate(starts)]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*cells), (pa.int32(), pa.int32(), pa.binary()))]
        for k in range(len(cells)):  # one block a batch
            yield pa.RecordBatch.from_arrays([c.slice(k, 1) for c in columns], names=["i", "j", "part"])

    return fold


def _wide_pairs(df, exprs, stats, names: list[str]) -> list[tuple]:
    """Correlations of all pairs of many columns from one scan.

    Tasks write blocks of matrices, which are summed by block and by tens of tasks, so that no sum meets many of them.
    What reaches the driver is four numbers a pair. Pairs of which one side hardly varies where the other is there are
    summed anew, exactly, by one aggregate a hundred pairs.
    """
    centered = df.select(*[(exprs[c] - F.lit(stats[c]["mean"])).alias(f"_x{k}") for k, c in enumerate(names)])
    tasks = max(1, df.rdd.getNumPartitions())
    parts = centered.mapInArrow(_products(_MATRIX), "i int, j int, part binary").withColumn("g", F.spark_partition_id())
    while tasks > 1:
        tasks = -(-tasks // _MET_BLOCKS)
        parts = parts.withColumn("g", F.pmod("g", F.lit(tasks))).groupBy("i", "j", "g").applyInPandas(_adder(), parts.schema)
    p = len(names)
    sums = np.zeros((4, p, p))
    for r in parts.toLocalIterator():
        a, b = r["i"] * _MATRIX, r["j"] * _MATRIX
        shape = (4, min(_MATRIX, p - a), min(_MATRIX, p - b))
        sums[:, a : a + _MATRIX, b : b + _MATRIX] += np.frombuffer(r["part"]).reshape(shape)
    products, ones, squares, n = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = squares - ones * ones / n
        value = (products - ones * ones.T / n) / (np.sqrt(spread) * np.sqrt(spread.T))
        # Rounding could make a constant vary, or the other way round.
        unsure = (n >= 2) & ~((spread > 1e-9 * squares) & (spread.T > 1e-9 * squares.T))
    rows, again = [], []
    for i, j in zip(*np.triu_indices(p, 1)):
        if unsure[i, j]:
            again.append((names[i], names[j]))
        elif n[i, j] >= 2 and not np.isnan(value[i, j]):
            rows.append((names[i], names[j], float(value[i, j]), int(n[i, j])))
    for k in range(0, len(again), _AGAIN):
        rows += _summed_pairs(df, exprs, stats, again[k : k + _AGAIN])
    return rows


def _gapless(s: dict) -> bool:
    return s["n"] == s["rows"]


def segments(
    df: DataFrame,
    types: dict[str, str],
    columns: list[str] | None = None,
    measure: str | None = None,
    top: int = 10,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """The most frequent values of each CATEGORICAL / BOOLEAN column.

    Each comes with its share of all rows and the mean and median of
    ``measure`` (the first NUMERIC column unless given). Only the chosen values
    enter the median search, whose groups never meet in one task.
    """
    df = ensure_rows(df)
    dims = [c for c in (columns or columns_of(types, CATEGORICAL, BOOLEAN)) if c in df.columns]
    numeric = columns_of(types, NUMERIC)
    measure = measure or (numeric[0] if numeric else None)
    schema = "dimension string, value string, row_count long, share double, numeric_aggregates map<string,double>"
    if not dims:
        return local_frame(df.sparkSession, [], schema)

    number = numeric_exprs(df, [measure]).get(measure) if measure else None
    number = number if number is not None else F.lit(None).cast("double")
    long = dimension_values(df, dims, number)
    counts = long.groupBy("slot", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ROW).alias("first"),
        F.count("x").alias("n_x"),
        F.avg("x").alias("mean"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    )
    chosen = [r for r in top_ranked(counts, ["slot"], top).orderBy("slot", "rank").collect()]
    per_slot: dict[int, int] = {}
    for r in chosen:
        per_slot[r["slot"]] = per_slot.get(r["slot"], 0) + 1
    chosen = [r for r in chosen if per_slot[r["slot"]] >= 2]

    medians = {}
    if measure and chosen:
        bounds = [{"slot": r["slot"], "value": r["value"], "n": r["n_x"], "low": r["low"], "high": r["high"]} for r in chosen]
        medians = order_statistics(long, ["slot", "value"], "x", {"median": MEDIAN}, bounds, small_group)
    total = df.count() if chosen else 0
    rows = []
    for r in chosen:
        aggregates = {}
        if measure and r["n_x"]:
            aggregates[f"mean_{measure}"] = r["mean"]
            aggregates[f"median_{measure}"] = medians[(r["slot"], r["value"])]["median"]
        rows.append((dims[r["slot"]], r["value"], r["n"], r["n"] / total, aggregates))
    return local_frame(df.sparkSession, rows, schema)


def dimension_values(df: DataFrame, dims: list[str], number: Column) -> DataFrame:
    """(_row, slot, value, x) per non-NULL cell of the dimension columns."""
    by_kind = C.kinds(df, dims)
    wide = df.select(ROW, number.alias("x"), *[C.text_of(C.col(d), by_kind[d]).alias(f"_d{i}") for i, d in enumerate(dims)])
    long = wide.unpivot([ROW, "x"], [f"_d{i}" for i in range(len(dims))], "_name", "value")
    return long.filter(F.col("value").isNotNull()).select(
        ROW, F.substring("_name", 3, 6).cast("int").alias("slot"), "value", "x"
    )
