"""Packing of documents into training sequences as a cutting-stock problem.

Texts are cut at multiples of the capacity; what is left of each is an item. Item lengths are counted in classes that
are at most 1/256 wider than their members, so the problem has at most 768 classes however many documents there are.
Column generation solves the linear program over patterns (how many items of each class one sequence takes): a simplex
step picks among known patterns, a knapsack over the duals prices new ones, until no pattern can lower the bound by
more than the tolerance. Whole multiples of the patterns are kept, the bounded remainder is filled largest first.
Items are then ranked within their class and take the pattern places of that class in turn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.llm.common import keep, python_tasks
from tabsight.llm.tokens import END_ID, TOKENIZER, TokenEncoder

CAPACITY = 4096
#: Lengths up to this have a class each; each doubling above is cut into half as many classes.
_EXACT = 256
#: Ranks are counted in buckets of about so many pieces.
BUCKET_ROWS = 20_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cut each document (``doc_id``, ``text``) into runs of at most ``capacity`` ids.

    Returns ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, if asked, ``ids``. A null or empty
    text is the end id alone; repeated rows give repeated pieces; a null doc_id is kept.
    """
    python_tasks(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenEncoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text, end_id).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)) + ((part.astype(np.int32),) if with_ids else ()))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = ", ".join(f"{n} long" for n in names[:5]) + ", ids array<int>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def class_of(length: Column) -> Column:
    """The class of a length: the length itself up to 256, then rounded up to 1/256 to 1/128 of it."""
    width = F.expr(f"shiftleft(1L, cast(greatest(0, ceil(log2(length / {_EXACT}d))) as int))")
    return (F.ceil(length / width) * width).cast("long")


def _largest_first(size: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Fill one sequence after the other from the largest class down; each pattern as often as the counts allow.

    Every pattern uses up a class, or as much of one as fits, so their number depends on the classes alone.
    """
    left, found = left.copy(), []
    while left.any():
        room, column = capacity, {}
        for i in np.flatnonzero(left)[::-1]:
            if k := min(int(left[i]), room // int(size[i])):
                column[int(i)] = k
                room -= k * int(size[i])
        times = min(int(left[i]) // k for i, k in column.items())
        for i, k in column.items():
            left[i] -= times * k
        found.append((times, column))
    return found


class _Program:
    """Linear program over the patterns known so far: use the fewest sequences so that every class gets its count.

    A revised simplex method that starts from patterns of one class each.
    """

    def __init__(self, size: np.ndarray, counts: np.ndarray, capacity: int):
        fill = capacity // size
        self.size, self.counts, self.capacity = size, counts.astype(float), capacity
        self.basis: list[dict[int, int]] = [{i: int(k)} for i, k in enumerate(fill)]
        self.inverse = np.diag(1.0 / fill)
        self.amount = self.counts / fill
        self.duals = 1.0 / fill
        self.pool: list[dict[int, int]] = []
        self.known: set[tuple] = set()
        self.at, self.times = np.zeros((0, 1), int), np.zeros((0, 1))

    def add(self, patterns: list[dict[int, int]]) -> bool:
        new = [p for p in patterns if (key := tuple(sorted(p.items()))) not in self.known and not self.known.add(key)]
        if not new:
            return False
        width = max(self.at.shape[1], *(len(p) for p in new))
        at, times = np.full((len(new), width), len(self.size)), np.zeros((len(new), width))
        for row, p in enumerate(new):
            at[row, : len(p)], times[row, : len(p)] = list(p), list(p.values())
        grow = ((0, 0), (0, width - self.at.shape[1]))
        self.at = np.vstack([np.pad(self.at, grow, constant_values=len(self.size)), at])
        self.times = np.vstack([np.pad(self.times, grow), times])
        self.pool += new
        return True

    def optimize(self, steps: int) -> None:
        """Let the pattern that pays most enter, until none does."""
        for _ in range(steps):
            gains = (np.append(self.duals, 0.0)[self.at] * self.times).sum(1) - 1.0
            best = int(gains.argmax())
            if gains[best] <= 1e-7:
                return
            column = self.pool[best]
            step = self.inverse[:, list(column)] @ np.array(list(column.values()), float)
            rows = np.flatnonzero(step > 1e-9)
            ratio = self.amount[rows] / step[rows]
            row = int(rows[ratio.argmin()])
            move = self.amount[row] / step[row]
            self.amount = np.maximum(self.amount - move * step, 0.0)
            self.amount[row] = move
            lead = self.inverse[row] / step[row]
            step[row] -= 1.0
            self.inverse -= np.outer(step, lead)
            self.duals = self.duals - gains[best] * lead
            self.basis[row] = column

    def price(self, duals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Knapsack: the best value within each length, and the item that ends it (-1: the length before is as good)."""
        value, last = np.zeros(self.capacity + 1), np.full(self.capacity + 1, -1)
        ends = np.searchsorted(self.size, np.arange(self.capacity + 1), side="right")
        for room in range(1, self.capacity + 1):
            value[room] = value[room - 1]
            if k := ends[room]:
                tries = value[room - self.size[:k]] + duals[:k]
                best = int(tries.argmax())
                if tries[best] > value[room] + 1e-12:
                    value[room], last[room] = tries[best], best
        return value, last

    def pattern(self, last: np.ndarray, first: int) -> dict[int, int]:
        """The best pattern that holds a given class."""
        found, room = {first: 1}, self.capacity - int(self.size[first])
        while room > 0:
            item = int(last[room])
            if item < 0:
                room -= 1
            else:
                found[item] = found.get(item, 0) + 1
                room -= int(self.size[item])
        return found


def cutting_stock(
    sizes: list[int], counts: list[int], capacity: int, tolerance: float = 5e-4, rounds: int = 12, steps: int = 2000
) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: items}) patterns that hold every item exactly once; sizes ascending, counts positive.

    The program starts with the largest-first patterns. Each round solves it over the patterns known, prices new ones
    at duals held near those of the best bound so far (they swing otherwise), and adds the best one for each class. It
    ends at a proven gap of ``tolerance``, or after the rounds; either way the answer is whole, only padding differs.
    """
    if not len(sizes):
        return []
    size, left = np.array(sizes, np.int64), np.array(counts, np.int64)
    program = _Program(size, left, capacity)
    program.add([column for _, column in _largest_first(size, left, capacity)])
    held = size / capacity
    bound = float(program.counts @ held)
    for _ in range(rounds):
        program.optimize(steps)
        duals = 0.9 * held + 0.1 * program.duals
        value, last = program.price(duals)
        if (new := float(program.counts @ duals) / value[-1]) > bound:
            bound, held = new, duals / value[-1]
        if program.amount.sum() - bound <= tolerance * bound:
            break
        if not program.add([program.pattern(last, first) for first in range(len(size))]):
            break
    found = []
    for times, column in sorted(zip(program.amount, program.basis, strict=True), key=lambda x: -x[0]):
        whole = min(int(times + 1e-6), *(int(left[i]) // k for i, k in column.items()))
        if whole > 0:
            for i, k in column.items():
                left[i] -= whole * k
            found.append((whole, column))
    found += _largest_first(size, left, capacity)
    return [(times, {int(size[i]): k for i, k in column.items()}) for times, column in found]


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its ``sequence_id`` and its gapless ``offset`` there.

    ``found``: pieces with ``doc_id``, ``start``, ``length`` from 1 to the capacity, and any columns that ride along.
    The driver gets one count per class (768 at most). Ranks within a class come from counts of many buckets, so a
    class with a third of all pieces is spread. Pieces equal in all columns may swap places. An empty input gives an
    empty result.
    """
    spark = found.sparkSession
    sized = found.withColumn("_class", F.when(F.col("length") > capacity, F.raise_error(F.lit("a piece is too long")).cast("long")).otherwise(F.least(class_of(F.col("length")), F.lit(capacity))))
    total = sized.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).orderBy("_class").collect()
    patterns = cutting_stock([r["_class"] for r in total], [r["n"] for r in total], capacity)
    places, first, filled = [], 0, {}
    for times, column in patterns:
        for size, k in sorted(column.items(), reverse=True):
            low = filled.get(size, 0)
            filled[size] = low + k * times
            places.append((size, low, filled[size], k, first))
        first += times
    # Proven size: at most two patterns for each of 768 classes.
    slots = spark.createDataFrame(places, "_class long, _low long, _high long, _k long, _first long")
    buckets = max(64, sum(r["n"] for r in total) // BUCKET_ROWS)
    dealt = sized.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    earlier = W.partitionBy("_class").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counted = dealt.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counted.select("_class", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_class", "_bucket").orderBy("doc_id", "start", *[c for c in found.columns if c not in ("doc_id", "start")])
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1).join(before, ["_class", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_bucket")
    a, s = ranked.alias("a"), F.broadcast(slots).alias("s")
    placed = a.join(s, F.expr("a._class = s._class and a._rank >= s._low and a._rank < s._high")).select(
        "a.*", F.expr("s._first + (a._rank - s._low) div s._k").alias("sequence_id")
    )
    within = W.partitionBy("sequence_id").orderBy(F.desc("length"), "_rank").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long")
    return placed.withColumn("offset", offset).drop("_class", "_rank")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``doc_id``, ``text``; the pieces are written once, so texts are encoded once."""
    return pack(keep(pieces(docs, capacity, tokenizer, end_id, with_ids), "pieces"), capacity)
