"""Exact order statistics per group without sorting or collecting a group.

Groups no larger than ``small_group`` rows are sorted inside one array of that
proven size. Larger groups are narrowed first: each pass counts the rows of
every group in a few thousand value bins (combined map-side, so the shuffle is
bins, not rows) and keeps the bin that holds the wanted rank. A bin that holds
one distinct value is an answer, however many rows share it, so a hot value
ends the search instead of filling a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabsight.sources.local import local_frame

SMALL_GROUP = 262_144
BINS = 4_096

Rank = Callable[[int], tuple[int, int, float]]
"""Row count to (lower rank, upper rank, weight of the upper one), ranks from 0."""


def linear(q: float) -> Rank:
    """Interpolated quantile at position ``(n - 1) * q``."""

    def ranks(n: int) -> tuple[int, int, float]:
        position = (n - 1) * q
        low = math.floor(position)
        return low, math.ceil(position), position - low

    return ranks


def floor_index(q: float) -> Rank:
    """The value at index ``int((n - 1) * q)``."""

    def ranks(n: int) -> tuple[int, int, float]:
        k = max(0, int((n - 1) * q))
        return k, k, 0.0

    return ranks


def upper_middle(n: int) -> tuple[int, int, float]:
    return n // 2, n // 2, 0.0


MEDIAN = linear(0.5)


@dataclass
class _Search:
    """Interval of one group that still contains at least one wanted rank."""

    group: tuple
    low: float
    high: float
    rows: int
    below: int
    ranks: tuple[int, ...]


def _counted(weight: str | None) -> Column:
    return F.sum(weight) if weight else F.count(F.lit(1))


def group_bounds(values: DataFrame, groups: list[str], value: str, weight: str | None = None) -> list:
    """(group..., n, rows, low, high) rows; one per group."""
    return (
        values.filter(F.col(value).isNotNull())
        .groupBy(*groups)
        .agg(_counted(weight).alias("n"), F.count(F.lit(1)).alias("rows"), F.min(value).alias("low"), F.max(value).alias("high"))
        .collect()
    )


def order_statistics(
    values: DataFrame,
    groups: list[str],
    value: str,
    wanted: dict[str, Rank],
    bounds: Iterable | None = None,
    small_group: int = SMALL_GROUP,
    bins: int = BINS,
    weight: str | None = None,
) -> dict[tuple, dict[str, float]]:
    """``{group: {name: value}}`` for a number of groups bounded by columns.

    ``bounds`` may carry the (group..., n, low, high) rows of an earlier pass. A row counts as often as the whole number
    ``weight`` says; ``n`` is then the sum of the weights, and the rows need ``rows``, how many there are.
    """
    values = values.select(*groups, value, *([weight] if weight else [])).filter(F.col(value).isNotNull())
    if bounds is None:
        bounds = group_bounds(values, groups, value, weight)
    found: dict[tuple, dict[int, float]] = {}
    sizes: dict[tuple, int] = {}
    searches: list[_Search] = []
    for row in bounds:
        group = tuple(row[g] for g in groups)
        if not row["n"]:
            continue
        sizes[group] = row["n"]
        found[group] = {}
        ranks = sorted({r for pick in wanted.values() for r in pick(row["n"])[:2]})
        searches.append(_Search(group, row["low"], row["high"], row["rows" if weight else "n"], 0, tuple(ranks)))

    first_pass = True
    while searches:
        large = []
        small = []
        for s in searches:
            if s.low == s.high:
                found[s.group].update({r: s.low for r in s.ranks})
            elif s.rows <= small_group:
                small.append(s)
            else:
                large.append(s)
        if small:
            _finish(values, groups, value, small, found, weight)
        searches = _narrow(values, groups, value, large, bins, first_pass, weight) if large else []
        first_pass = False

    result: dict[tuple, dict[str, float]] = {}
    for group, n in sizes.items():
        result[group] = {}
        for name, pick in wanted.items():
            low, high, weight = pick(n)
            a, b = found[group][low], found[group][high]
            if weight == 0.5:
                result[group][name] = (a + b) / 2
            else:
                result[group][name] = a if low == high else a + (b - a) * weight
    return result


def _search_table(values: DataFrame, groups: list[str], value: str, searches: list[_Search]) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    keys = [f"_g{i} {types[g]}" for i, g in enumerate(groups)]
    schema = ", ".join([*keys, "_id int", f"_low {types[value]}", f"_high {types[value]}"])
    rows = [(*s.group, i, s.low, s.high) for i, s in enumerate(searches)]
    return local_frame(values.sparkSession, rows, schema)


def _candidates(values: DataFrame, groups: list[str], value: str, table: DataFrame, weight: str | None) -> DataFrame:
    """The values inside the intervals of their group."""
    match = (F.col(value) >= F.col("_low")) & (F.col(value) <= F.col("_high"))
    for i, g in enumerate(groups):
        match = match & (F.col(g) == F.col(f"_g{i}"))
    extra = [c for c in table.columns if not c.startswith("_g")]
    if weight:
        extra.append(F.col(weight).alias("_w"))
    # A handful of intervals per group; groups are columns or top values.
    return values.join(F.broadcast(table), match).select(F.col(value).alias("_v"), *extra)


def _finish(values, groups, value, searches: list[_Search], found, weight: str | None) -> None:
    """Sort each proven-small interval in one array and read the ranks; of weighted rows by their running sum."""
    ranks = local_frame(values.sparkSession, [(i, r, r - s.below + 1) for i, s in enumerate(searches) for r in s.ranks],
        "_rid int, _rank long, _at long",
    )
    table = _search_table(values, groups, value, searches)
    candidates = _candidates(values, groups, value, table, weight)
    if weight:
        up_to = W.partitionBy("_id").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
        ends = candidates.groupBy("_id", "_v").agg(F.sum("_w").alias("_w")).withColumn("_end", F.sum("_w").over(up_to))
        hit = (F.col("_id") == F.col("_rid")) & (F.col("_at") <= F.col("_end")) & (F.col("_at") > F.col("_end") - F.col("_w"))
        picked = ends.join(F.broadcast(ranks), hit).select("_id", "_rank", F.col("_v").alias("_value"))
    else:
        arrays = candidates.groupBy("_id").agg(F.sort_array(F.collect_list("_v")).alias("_sorted"))
        picked = arrays.join(F.broadcast(ranks), F.col("_id") == F.col("_rid")).select(
            "_id", "_rank", F.element_at("_sorted", F.col("_at").cast("int")).alias("_value")
        )
    for row in picked.collect():
        found[searches[row["_id"]].group][row["_rank"]] = row["_value"]


def _narrow(values, groups, value, searches: list[_Search], bins: int, first_pass: bool, weight: str | None) -> list[_Search]:
    """One counting pass over the bins of every interval."""

    def place(c: Column) -> Column:
        # Halved so that a range wider than the largest double stays finite. Signed
        # logarithm at first: bins follow magnitude, so far outliers cost no extra passes.
        c = c.cast("double")
        return (F.signum(c) * F.log1p(F.abs(c)) if first_pass else c) * 0.5

    share = F.try_divide(place(F.col("_v")) - F.col("_from"), F.col("_span"))
    # The ends get bins of their own, so every pass shrinks the interval.
    bin_ = (
        F.when(F.col("_v") == F.col("_low"), F.lit(0))
        .when(F.col("_v") == F.col("_high"), F.lit(bins + 1))
        .when(F.isnan(share) | share.isNull(), F.lit(1))
        .otherwise(F.least(F.floor(share * bins) + 1, F.lit(bins)))
    )
    table = _search_table(values, groups, value, searches)
    table = table.withColumn("_from", place(F.col("_low"))).withColumn("_span", place(F.col("_high")) - F.col("_from"))
    counted = (
        _candidates(values, groups, value, table, weight)
        .groupBy("_id", bin_.cast("int").alias("_bin"))
        .agg(
            _counted("_w" if weight else None).alias("_n"), F.count(F.lit(1)).alias("_rows"),
            F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        )
    )
    before = W.partitionBy("_id").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    running = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranks = local_frame(values.sparkSession, [(i, r, r - s.below) for i, s in enumerate(searches) for r in s.ranks],
        "_rid int, _rank long, _within long",
    )
    hit = (
        (F.col("_id") == F.col("_rid"))
        & (F.col("_within") >= F.col("_before"))
        & (F.col("_within") < F.col("_before") + F.col("_n"))
    )
    rows = running.join(F.broadcast(ranks), hit).collect()
    narrowed: dict[tuple, _Search] = {}
    for row in rows:
        s = searches[row["_id"]]
        key = (row["_id"], row["_bin"])
        known = narrowed.get(key)
        ranks_here = (known.ranks if known else ()) + (row["_rank"],)
        narrowed[key] = _Search(s.group, row["_min"], row["_max"], row["_rows"], s.below + row["_before"], ranks_here)
    return list(narrowed.values())


def column_order_statistics(
    df: DataFrame,
    columns: dict[str, Column],
    wanted: dict[str, Rank],
    stats: Iterable | None = None,
    small_group: int = SMALL_GROUP,
) -> dict[str, dict[str, float]]:
    """Order statistics of numeric expressions: ``{column: {name: value}}``.

    ``stats`` may carry (column, n, low, high) records of an earlier pass.
    """
    slots = {c: f"_x{i}" for i, c in enumerate(columns)}
    wide = df.select(*[e.alias(slots[c]) for c, e in columns.items()])
    long = wide.unpivot([], list(slots.values()), "slot", "value")
    bounds = None
    if stats is not None:
        bounds = [{"slot": slots[s["column"]], "n": s["n"], "low": s["low"], "high": s["high"]} for s in stats]
    found = order_statistics(long, ["slot"], "value", wanted, bounds, small_group)
    return {c: found[(slot,)] for c, slot in slots.items() if (slot,) in found}
