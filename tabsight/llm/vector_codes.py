"""Product codes of vectors: integer codebooks fitted over all rows, entries searched by LAESA pivots.

Every vector is cut into equal parts, and every part position has a codebook of a few entries. The distances of a part
to some pivots, which never change, are computed once and kept beside the rows. In each round the distances of the
pivots to the current entries (a few numbers) bound every part-to-entry distance from below by the triangle
inequality: |d(part, pivot) - d(pivot, entry)|. Entries are tried in the order of their bounds, by exact whole-number
distances, until a bound exceeds the best distance found.

A round is one narrow scan: tasks add up their parts per (length, part, entry, place), the sums are combined by Spark,
and the new entries, as many numbers as one codebook holds, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.llm.common import keep, python_tasks

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Pivots of each part position; the first entries stand for them.
PIVOTS = 4
#: Rows of one salt of the join that returns the sums of labels.
SALT_ROWS = 200_000
#: Distances below this are whole in a double and in a long.
_EXACT = float(1 << 52)

#: Length of a vector to its codebooks: whole numbers in an array of shape (parts, entries, width).
Codebooks = dict[int, np.ndarray]

_ROWS = "vec_id long, label_key string, dim int, vector binary"


def whole_vectors(vectors: DataFrame, vector: str = "embedding", label: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label_key``, ``dim``, ``vector``: floor(scale * x) as doubles, which hold these numbers exactly.

    Vectors that are null, hold null or non-finite components (also after scaling) or cannot be cut into equal parts
    are left out. ``label_key`` is the label's text, null for null.
    """
    python_tasks(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, cells, dims = [], [], []
            for i, row in _finite_rows(batch.column(2), scale):
                if len(row) % parts == 0:
                    taken.append(i), cells.append(row.tobytes()), dims.append(len(row))
            taken = pa.array(taken, pa.int64())
            columns = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(dims, pa.int32()), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label_key", "dim", "vector"])

    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col(label).cast("string").alias("label_key"),
        F.col(vector).cast("array<double>").alias("embedding"),
    )
    return rows.mapInArrow(run, _ROWS)


def _finite_rows(column: pa.ListArray, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, floor(scale * x)) of the vectors of a batch without null or non-finite numbers."""
    lengths = np.diff(column.offsets.to_numpy())
    plain = not column.null_count and not column.flatten().null_count
    with np.errstate(over="ignore", invalid="ignore"):
        if plain and len(lengths) and (lengths == lengths[0]).all():
            whole = np.floor(column.flatten().to_numpy().reshape(len(lengths), -1) * scale)
            finite = np.isfinite(whole).all(axis=1)
            yield from ((i, whole[i]) for i in np.flatnonzero(finite).tolist())
            return
        for i, cell in enumerate(column.to_pylist()):
            if cell is not None and None not in cell:
                row = np.floor(np.array(cell, np.float64) * scale)
                if np.isfinite(row).all():
                    yield i, row


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """For each length of vectors the parts of its ``entries`` smallest ids; null ids come last.

    Rows that repeat an id count once, with the vector of the smallest digest (ties are equal vectors). At most
    ``entries`` vectors of each length reach the driver, taken below the exchange.
    """
    ids = rows.select(F.col("dim").alias("d"), F.col("vec_id").alias("id")).distinct()
    ids = ids.withColumn("rank", F.row_number().over(W.partitionBy("d").orderBy(F.asc_nulls_last("id"))))
    firsts = F.broadcast(ids.where(F.col("rank") <= entries))  # ``entries`` ids of each length
    same = (F.col("dim") == F.col("d")) & F.col("vec_id").eqNullSafe(F.col("id"))
    once = rows.join(firsts, same).groupBy("dim", "rank").agg(F.min(F.struct(F.sha2("vector", 256), "vector")).alias("v"))
    found: dict[int, list[np.ndarray]] = {}
    for row in once.orderBy("dim", "rank").collect():
        found.setdefault(row["dim"], []).append(np.frombuffer(row["v"]["vector"]))
    return {dim: np.stack([v.reshape(parts, dim // parts) for v in vectors], axis=1) for dim, vectors in found.items()}


def _integers(x: np.ndarray) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)


def fitting(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as they are if doubles hold all squared distances between them exactly, else of Python's integers."""
    largest = 2 * max(float(np.abs(x).max(initial=0)) for x in arrays)
    small = largest * largest * max(arrays[0].shape[-1], 1) < _EXACT
    return tuple(x.astype(np.float64) if small else _integers(x) for x in arrays)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances; exact for arrays as from ``fitting``."""
    apart = a - b
    return (apart * apart).sum(axis=-1)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of parts (rows, parts, width) to the pivots (parts, pivots, width) of their position, as 4-byte floats."""
    parts, pivots = fitting(parts, pivots)
    with np.errstate(over="ignore"):
        return np.stack([_roots(distances(parts, pivots[None, :, k])) for k in range(pivots.shape[1])], axis=-1).astype(np.float32)


def lower_bounds(to_pivots: np.ndarray, entry_pivots: np.ndarray) -> np.ndarray:
    """No part is nearer to an entry: (rows, pivots) and (entries, pivots) distances to (rows, entries) bounds.

    The slack covers the rounding of 4-byte floats; a distance beyond their range bounds nothing.
    """
    bounds = np.zeros((len(to_pivots), len(entry_pivots)))
    for k in range(to_pivots.shape[1]):
        one, other = to_pivots[:, k, None].astype(np.float64), entry_pivots[None, :, k]
        with np.errstate(invalid="ignore"):
            bounds = np.fmax(bounds, np.abs(one - other) - 1e-6 * (one + other))
    return bounds


def nearest(rows: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry, ties to the lower index, and the distances evaluated."""
    rows, entries, pivots = fitting(rows, entries, pivots)
    bounds = lower_bounds(to_pivots, np.stack([_roots(distances(entries, p[None])) for p in pivots], axis=-1))
    order = np.argsort(bounds, axis=1, kind="stable")
    best = order[:, 0].copy()
    least = distances(rows, entries[best])
    active, evaluated = np.arange(len(rows)), len(rows)
    for rank in range(1, len(entries)):
        candidate = order[active, rank]
        bound = bounds[active, candidate]
        # Bounds rise with the rank and the best distance falls: a row that is out stays out.
        open_rows = bound * bound * (1 - 1e-9) <= least[active]
        active, candidate = active[open_rows], candidate[open_rows]
        if not len(active):
            break
        evaluated += len(active)
        found = distances(rows[active], entries[candidate])
        better = (found < least[active]) | ((found == least[active]) & (candidate < best[active]))
        best[active[better]], least[active[better]] = candidate[better], found[better]
    return best, least, evaluated


def with_pivots(rows: DataFrame, pivots: Codebooks, parts: int = PARTS) -> DataFrame:
    """``rows`` with ``to_pivots``: the distances of every part to the pivots of its position, as 4-byte floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[bytes | None] = [None] * batch.num_rows
            for dim, at, own in _by_length(batch, parts):
                for i, cell in zip(at, pivot_distances(own, pivots[dim]), strict=True):
                    cells[i] = cell.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], names=[*batch.schema.names, "to_pivots"])

    return rows.mapInArrow(run, f"{_ROWS}, to_pivots binary")


def _by_length(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of its rows in the batch, their parts) for each length there is."""
    dims = batch.column("dim").to_numpy()
    cells = batch.column("vector").to_pylist()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, np.frombuffer(b"".join(cells[i] for i in at)).reshape(len(at), parts, dim // parts)


def _assigned(batch: pa.RecordBatch, books: Codebooks, pivots: Codebooks, parts: int):
    """(length, places, parts, codes, distances) for each length in a batch."""
    cells = batch.column("to_pivots").to_pylist()
    for dim, at, own in _by_length(batch, parts):
        known = np.frombuffer(b"".join(cells[i] for i in at), np.float32).reshape(len(at), parts, -1)
        found = [nearest(own[:, p], known[:, p], books[dim][p], pivots[dim][p]) for p in range(parts)]
        yield dim, at, own, np.stack([f[0] for f in found], axis=1), [f[1] for f in found]


def entry_sums(rows: DataFrame, books: Codebooks, pivots: Codebooks, parts: int = PARTS) -> DataFrame:
    """``dim``, ``part``, ``entry``, ``place``, ``limb``, ``total``, ``n``: sums of the parts assigned to each entry.

    Tasks add up before anything is shuffled. A sum is the sum of its limbs, each times 2 ** (60 * limb).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            for dim, _, own, codes, _ in _assigned(batch, books, pivots, parts):
                small = np.abs(own).max(initial=0) * len(own) < _EXACT
                for p in range(parts):
                    for entry in np.unique(codes[:, p]).tolist():
                        mine = own[codes[:, p] == entry, p]
                        added = mine.sum(axis=0) if small else np.vectorize(int, otypes=[object])(mine).sum(axis=0)
                        known = sums.setdefault((dim, p, entry), [0, [0] * mine.shape[1]])
                        known[0] += len(mine)
                        known[1] = [a + int(b) for a, b in zip(known[1], added.tolist(), strict=True)]
        out = [(*key, place, limb, part, n) for key, (n, totals) in sums.items() for place, total in enumerate(totals) for limb, part in _limbs(total)]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = (*[pa.int32()] * 5, pa.int64(), pa.int64())
        names = ["dim", "part", "entry", "place", "limb", "total", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    found = rows.mapInArrow(run, "dim int, part int, entry int, place int, limb int, total long, n long")
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    return found.groupBy("dim", "part", "entry", "place", "limb").agg(total, F.sum("n").alias("n"))


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """The 60-bit limbs of a whole number; the last one carries the sign. Only the lowest for usual numbers."""
    limb = 0
    while not -(1 << 62) < total < 1 << 62:
        yield limb, total & ((1 << 60) - 1)
        total, limb = total >> 60, limb + 1
    yield limb, total


def fit_codebooks(rows: DataFrame, first: Codebooks, rounds: int = ROUNDS, parts: int = PARTS) -> Codebooks:
    """Codebooks after ``rounds`` rounds over ``rows`` (as from ``with_pivots`` of the first entries).

    Each round assigns all parts and moves every used entry to the floor of its parts' mean; unused entries stay.
    """
    pivots = {dim: book[:, :PIVOTS] for dim, book in first.items()}
    books = {dim: book.copy() for dim, book in first.items()}
    for _ in range(rounds if books else 0):
        sums: dict[tuple[int, ...], tuple[int, int]] = {}
        for r in entry_sums(rows, books, pivots, parts).collect():  # as many rows as the codebooks have numbers
            key = (r["dim"], r["part"], r["entry"], r["place"])
            total, n = sums.get(key, (0, 0))
            # Every task has a lowest limb for each of its sums, and only that one counts parts.
            sums[key] = (total + (int(r["total"]) << (60 * r["limb"])), max(n, r["n"]))
        for (dim, *place), (total, n) in sums.items():
            mean = total // n
            if abs(mean) >= _EXACT and books[dim].dtype != object:
                books[dim] = _integers(books[dim])
            books[dim][tuple(place)] = mean
    return books


def codebooks_sha256(book: np.ndarray) -> str:
    """Lowercase hex digest of all entries' whole numbers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in book.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: Codebooks, first: Codebooks, parts: int = PARTS) -> DataFrame:
    """``vec_id``, ``label_key``, ``code``, ``error``, ``codebooks_sha256``; an error that no long holds is null."""
    pivots = {dim: book[:, :PIVOTS] for dim, book in first.items()}
    digests = {dim: codebooks_sha256(book) for dim, book in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors, shas = ([None] * batch.num_rows for _ in range(3))
            for dim, at, _, found, apart in _assigned(batch, books, pivots, parts):
                written = found.astype(np.uint8).tobytes().hex()
                for k, i in enumerate(at.tolist()):
                    codes[i], shas[i] = written[2 * parts * k : 2 * parts * (k + 1)], digests[dim]
                    error = sum(int(a[k]) for a in apart)
                    errors[i] = error if error < 1 << 63 else None
            columns = [batch.column("vec_id"), batch.column("label_key"), pa.array(codes, pa.string()), pa.array(errors, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label_key", "code", "error", "codebooks_sha256"])

    return rows.mapInArrow(run, "vec_id long, label_key string, code string, error long, codebooks_sha256 string")


def vector_codes(vectors: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256``: one row for each vector that takes part.

    Null vectors and those with null or non-finite components are left out, as are those whose length is no multiple
    of ``PARTS``. Vectors of several lengths have codebooks of their own for each length. Repeated rows are coded (and
    weigh in the means) as often as they stand there; of rows that share an id one stands among the first entries. Ties
    of distance go to the lower entry. ``label_error`` sums the errors over equal labels, nulls together. An empty table
    gives an empty one. Only ``vec_id`` and the two named columns are read, so further columns cannot clash.

    Components may have any finite size: whole numbers beyond a double's exact range are computed as integers.
    """
    whole = keep(whole_vectors(vectors, vector, label), "vectors")
    first = first_codebooks(whole)
    rows = keep(with_pivots(whole, {dim: book[:, :PIVOTS] for dim, book in first.items()}), "pivot-distances")
    coded = keep(encode(rows, fit_codebooks(rows, first), first), "codes")
    # Equal labels: sums are combined map-side, then joined back by salted keys, so a label of many rows is many tasks.
    salts = max(1, -(-coded.count() // SALT_ROWS))
    named = coded.select("*", F.col("label_key").isNull().alias("no_label"), F.coalesce("label_key", F.lit("")).alias("label"))
    sums = named.groupBy("no_label", "label").agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as long)").alias("label_error"))
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = named.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    return dealt.join(salted, ["no_label", "label", "salt"]).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
