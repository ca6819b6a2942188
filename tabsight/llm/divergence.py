"""How far the word use of sources is apart: smoothed term shares of (lang, source) groups, compared exactly.

Term counts of a language form a matrix of groups by terms in which almost all cells are zero. The matrix is cut into
blocks of columns (terms, by hash) and of rows (groups); each pair of row blocks meets in a block of columns as one
task. There the cells become a k-squared tree with k = 2: every level holds a bit for each quadrant that has a nonzero
cell. Pairs of groups walk two rows of the tree jointly, all pairs of row nodes at once: a quadrant that is zero for
both is priced by its width times the divergence of two zero cells, whatever the number of pairs below it; other
quadrants are opened, down to cells, where the exact divergence is taken. Terms that no task of two row blocks saw are
one more such quadrant.

Counts come from one scan that adds up in its tasks before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.llm.common import keep, python_tasks

#: Parts of the whole that shares are counted in, documents a kept term needs, ranks of terms.
UNIT, LEAST_DOCUMENTS, TERM_RANKS = 1_000_000_000, 3, 200
#: Groups and terms of a block.
BLOCK_GROUPS, BLOCK_TERMS = 64, 1024
#: Different (lang, source, term) that a counting task holds before it writes them out.
HELD_TERMS = 400_000

#: Bytes to bytes: A-Z in lower case, other ASCII but a-z as a blank, the rest (parts of longer characters) as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` (rows that have it), several rows a key.

    Every group has a row of the term '' besides, whether or not its documents have terms.
    """
    python_tasks(docs.sparkSession)

    def rows_of(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        rows = [(lang, source, term.decode(), n, own[1][term]) for (lang, source), own in held.items() for term, n in own[0].items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.get((lang, source))
                if own is None:
                    own = held[lang, source] = (Counter({b"": 0}), Counter())
                before = len(own[0])
                words = text.encode().translate(_FOLD).split()
                own[0].update(words)
                own[1].update(set(words))
                size += len(own[0]) - before
                if size >= HELD_TERMS:
                    yield rows_of(held)
                    held, size = {}, 0
        yield rows_of(held)

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(run, _COUNTS)


def kept_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``, ``lang_n`` of terms in at least ``least`` rows of their language; a
    group's row of the term '' stays. At most as many rows as a language has sources meet for one term.
    """
    found = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    wide = found.withColumn("lang_n", F.sum("n").over(of_term)).withColumn("lang_docs", F.sum("docs").over(of_term))
    return wide.where((F.col("lang_docs") >= least) | (F.col("term") == "")).drop("docs", "lang_docs")


def share(count, total, terms):
    """1 + floor(UNIT * (count + 1) / (total + terms)) as a column of long; the product has up to 38 digits."""
    product = (count + 1).cast("decimal(27,0)") * F.lit(UNIT).cast("decimal(10,0)")
    # Without kept terms there is nothing to share out; any divisor will do.
    return F.call_function("div", product, F.greatest(total + terms, F.lit(1)).cast("decimal(27,0)")) + 1


def divergence(p, q):
    """floor((p - q)^2 / q) as a column of long; shares are at most UNIT + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


# --- the tree of a block -----------------------------------------------------------------------------------------


def shares_of(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), by long division in three steps so that no product overflows."""
    whole, rest = np.divmod(counts + 1, totals)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + more
    return whole + 1


def levels(cells: np.ndarray) -> list[np.ndarray]:
    """The k-squared tree of a matrix of bits, root first: each level halves both sides, up to one quadrant."""
    found = [cells]
    while found[0].shape != (1, 1):
        bits = found[0]
        bits = np.pad(bits, ((0, bits.shape[0] % 2 if bits.shape[0] > 1 else 0), (0, bits.shape[1] % 2 if bits.shape[1] > 1 else 0)))
        if bits.shape[0] > 1:
            bits = bits[0::2] | bits[1::2]
        if bits.shape[1] > 1:
            bits = bits[:, 0::2] | bits[:, 1::2]
        found.insert(0, bits)
    return found


def block_divergence(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, totals: np.ndarray, width: int, pairs_of: np.ndarray) -> np.ndarray:
    """Sums over ``width`` columns of the divergence of every two rows, [p, q]; cells (row, column, count) are unique.

    ``pairs_of`` names the row block of each row; with two different blocks, only pairs across them are summed (others
    are 0). Rows without cells take part.
    """
    height = len(totals)
    bits = np.zeros((height, max(width, 1)), bool)
    bits[rows, columns] = True
    held = np.zeros((height, max(width, 1)), np.int64)
    held[rows, columns] = counts
    share_at = shares_of(held, totals[:, None])
    zero = shares_of(np.zeros(height, np.int64), totals)
    tree = levels(bits)
    across = len(np.unique(pairs_of)) > 1
    sums = np.zeros((height, height), np.int64)
    blank = np.zeros((height, height), np.int64)  # columns where both rows lie in zero quadrants
    one = other = column = np.zeros(1, np.int64)  # pairs of row nodes, the first not after the second, with a column node
    for depth, level in enumerate(tree):
        # A quadrant reaches over so many rows and columns of cells, cut at the edges of the matrix.
        tall, long_ = (_reach(tree, depth, axis) for axis in (0, 1))
        if depth:
            halves = [range(2 if level.shape[axis] > tree[depth - 1].shape[axis] else 1) for axis in (0, 0, 1)]
            one, other, column = (
                (x[:, None] * len(half) + y.ravel()).ravel()
                for x, y, half in zip((one, other, column), np.meshgrid(*halves, indexing="ij"), halves, strict=True)
            )
            real = (one <= other) & (other < level.shape[0]) & (column < level.shape[1])
            if across:
                # Node pairs within one row block hold no pair that is wanted.
                real &= (pairs_of[np.minimum(one * tall, height - 1)] != pairs_of[np.minimum((other + 1) * tall, height) - 1])
            one, other, column = one[real], other[real], column[real]
        filled = level[one, column] | level[other, column]
        priced = np.zeros((level.shape[0], level.shape[0]), np.int64)
        np.add.at(priced, (one[~filled], other[~filled]), np.clip(width - column[~filled] * long_, 0, long_))
        blank += priced.repeat(tall, axis=0).repeat(tall, axis=1)[:height, :height]
        one, other, column = one[filled], other[filled], column[filled]
    wanted = one < other
    one, other, column = one[wanted], other[wanted], column[wanted]
    p, q = share_at[one, column], share_at[other, column]
    squares = (p - q) * (p - q)
    np.add.at(sums, (one, other), squares // q)
    np.add.at(sums, (other, one), squares // p)
    # The blank columns of a pair stand at (smaller row, larger row).
    upper = np.triu(blank, 1)
    sums += (upper + upper.T) * ((zero[:, None] - zero[None, :]) ** 2 // zero[None, :])
    if across:
        sums[pairs_of[:, None] == pairs_of[None, :]] = 0
    return sums


def _reach(tree: list[np.ndarray], depth: int, axis: int) -> int:
    """Rows (axis 0) or columns (axis 1) of cells that a quadrant of a level reaches over."""
    reach = 1
    for upper, lower in zip(tree[depth:], tree[depth + 1 :], strict=False):
        reach *= 2 if lower.shape[axis] > upper.shape[axis] else 1
    return reach


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs of two row blocks in one block of columns; rows of the term '' carry the groups."""
    groups = rows[rows["term"] == ""].drop_duplicates("group_no").sort_values("group_no")
    cells = rows[(rows["term"] != "") & (rows["n"] > 0)]
    order = {g: k for k, g in enumerate(groups["group_no"].tolist())}
    columns, terms = pd.factorize(cells["term"])
    totals = np.maximum((groups["total"] + groups["terms"]).to_numpy(np.int64), 1)
    at = cells["group_no"].map(order).to_numpy(np.int64)
    sums = block_divergence(at, columns.astype(np.int64), cells["n"].to_numpy(np.int64), totals, len(terms), groups["row_block"].to_numpy(np.int64))
    one, other = np.nonzero(~np.eye(len(order), dtype=bool))
    numbers = groups["group_no"].to_numpy(np.int64)
    found = pd.DataFrame({"p_no": numbers[one], "q_no": numbers[other], "value": sums[one, other], "seen": np.int64(len(terms))})
    blocks = groups["row_block"].to_numpy(np.int64)
    if len(np.unique(blocks)) > 1:
        found = found[blocks[one] != blocks[other]]
    return found.assign(lang=rows["lang"].iloc[0])


def divergences(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair``: the group against every other source of its language, all ranks. Part ``term``: the kept terms that
    the group uses more than its language does, up to ``ranks``. Ties go to the item of smaller UTF-8 bytes.

    Null lang, source and text are ''; a row counts as a document however often it is repeated, whatever its doc_id.
    Groups without terms, blank and very long texts take part; a language without kept terms has pairs of value 0. An
    empty table gives an empty one. Only ``lang``, ``source`` and ``text`` are read, so further columns cannot clash.
    """
    counts = keep(kept_counts(docs, least), "term-counts")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))  # a row of the term '' counts nothing
    langs = counts.where("term <> ''").select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    numbered = groups.withColumn("group_no", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    row_block = F.floor(F.col("group_no") / BLOCK_GROUPS).cast("int").alias("row_block")
    known = keep(numbered.join(langs, "lang", "left").fillna(0, ["terms", "lang_total"]).select("*", row_block), "groups")
    return _pairs(counts, known).unionByName(_terms(counts, known, ranks))


def _terms(counts: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    own = counts.where("n > 0").join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    valued = own.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    valued = valued.select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value"))
    # The limit on the rank is applied in each task before the exchange.
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Values of all ordered pairs of groups of a language."""
    row_blocks = F.max("row_block").over(W.partitionBy("lang")) + 1
    column_blocks = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1)).cast("int")
    own = groups.select("lang", "source", "group_no", "row_block", "total", "terms")
    placed = own.select("*", row_blocks.alias("row_blocks"), column_blocks.alias("column_blocks"))
    cells = counts.where("n > 0").select("lang", "source", "term", "n").join(placed, ["lang", "source"])
    cells = cells.withColumn("column_block", F.pmod(F.xxhash64("term"), F.col("column_blocks")).cast("int"))
    every_block = F.explode(F.sequence(F.lit(0), F.col("column_blocks") - 1)).alias("column_block")
    marks = placed.select("*", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), every_block)
    dealt = cells.unionByName(marks).select("*", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("partner"))
    # A block meets itself in one task and every other block in another, which leaves the pairs within a block out.
    dealt = dealt.withColumn("low", F.least("row_block", "partner")).withColumn("high", F.greatest("row_block", "partner"))
    tasks = dealt.select("lang", "low", "high", "column_block", "group_no", "row_block", "term", "n", "total", "terms")
    found = tasks.groupBy("lang", "low", "high", "column_block").applyInPandas(_compare, "lang string, p_no long, q_no long, value long, seen long")
    sums = found.groupBy("lang", "p_no", "q_no").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    p = groups.select("lang", F.col("group_no").cast("long").alias("p_no"), "source", "terms", share(F.lit(0), F.col("total"), F.col("terms")).alias("p0"))
    q = groups.select("lang", F.col("group_no").cast("long").alias("q_no"), F.col("source").alias("item"), share(F.lit(0), F.col("total"), F.col("terms")).alias("q0"))
    whole = sums.join(p, ["lang", "p_no"]).join(q, ["lang", "q_no"])
    # Terms that no task of the two row blocks saw: one quadrant, zero for both.
    rest = (F.col("terms") - F.col("seen")) * divergence(F.col("p0"), F.col("q0"))
    valued = whole.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + rest).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order))
