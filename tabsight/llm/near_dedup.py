"""Near duplicates among embeddings by sorted projection passes.

Each pass orders the vectors lexicographically by bits of random projections (and by a finer projection behind them)
and compares every vector with its neighbours in a bounded window. That only finds out what belongs together: vectors
at up to ``SLACK`` times the angle of the threshold are tied, and so is a run of equal keys that is longer than the
window. Tied vectors form clusters, and in a cluster all pairs are verified by their cosine in double precision, block
by block, each pair once. So links are counted exactly within a cluster, however far apart its vectors are ranked and
however large it grows; the reach follows the data. Equal vectors are one class with a weight. A task hands on only as
many links as join what it has found.

The number of passes grows with the table, so that two vectors at the threshold that nothing else ties still meet in a
window with a chance of ``MEET``. Measured recall against brute force is in the README.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.llm.common import components, keep, python_tasks

THRESHOLD = 0.95
PASSES, BITS, WINDOW, BLOCK = 8, 24, 1024, 1024
#: Vectors within this many times the threshold's angle are tied; a lone pair at the threshold meets with this chance.
SLACK, MEET = 1.5, 0.99
#: Rows of one side of a task that compares a cluster.
CLUSTER_ROWS = 4096


def passes_for(rows: int, threshold: float, passes: int, window: int) -> int:
    """``passes``, or as many as a lone pair at the threshold needs to meet in a window of so many rows."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    meet = agree ** max(0.0, math.log2(max(1, rows) / max(1, window)))
    return passes if meet >= 1 else max(passes, math.ceil(math.log(1 - MEET) / math.log(1 - meet)))


def _directions(dimension: int, seed: int, bits: int) -> np.ndarray:
    """Random directions of one pass; the last one orders vectors within equal bits."""
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, bits + 1))


def _keys(vectors: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    """``vec_id``, ``dim``, ``vector`` (its numbers as bytes) and ``keys``, one sortable key for each pass.

    Vectors that cannot link are left out. Floats stay floats, all else becomes doubles.
    """
    python_tasks(vectors.sparkSession)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    stored = np.dtype("<f4" if single else "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vec_id is None or not vector or None in vector:
                    continue
                row = np.array(vector, np.float64)
                if np.isfinite(row).all() and row.any():
                    ids.append(vec_id)
                    rows.append(row)
            for dim in sorted({len(r) for r in rows}):
                own = [k for k, r in enumerate(rows) if len(r) == dim]
                block = np.stack([rows[k] for k in own])
                unit, keys = _units(block), []
                for p in range(passes):
                    seen = unit @ _directions(dim, seed * 1000 + p, bits)
                    # The finer projection as a number whose bytes sort like it.
                    fine = ((np.clip(seen[:, -1] / np.sqrt(dim), -1, 1) + 1) * (2**31 - 1)).astype(">u4")
                    packed = np.packbits(seen[:, :-1] > 0, axis=1)
                    keys.append([a.tobytes() + b.tobytes() for a, b in zip(packed, fine, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[k] for k in own], pa.int64()),
                        pa.array([dim] * len(own), pa.int32()),
                        pa.array([r.astype(stored).tobytes() for r in block], pa.binary()),
                        pa.array([list(k) for k in zip(*keys, strict=True)], pa.list_(pa.binary())),
                    ],
                    names=["vec_id", "dim", "vector", "keys"],
                )

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, dim int, vector binary, keys array<binary>")


def _units(block: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that very large and very small ones neither overflow nor vanish."""
    block = block / np.abs(block).max(axis=1, keepdims=True)
    return block / np.sqrt((block * block).sum(axis=1, keepdims=True))


def _places(classes: DataFrame, bits: int) -> DataFrame:
    """``rep``, ``pass``, ``rank`` (dense, from 0) in the order of the pass's keys, and ``run``, the key's leading bits.

    One range sort over all passes; a row's position is its place in its part and the rows of the parts before.
    """
    rows = classes.select("rep", F.posexplode("keys").alias("pass", "key"))
    ordered = keep(rows.orderBy("pass", "key", "rep").withColumn("_at", F.monotonically_increasing_id()), "projection-order")
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    lead = F.conv(F.hex(F.substring("key", 1, -(-bits // 8))), 16, 10).cast("long")
    # Every pass holds every class once: the ranks of a pass begin after as many rows as the passes before have.
    return ordered.withColumn("_part", part).join(offsets, "_part").select("rep", "pass", place.alias("place"), lead.alias("run"))


def _joined(near: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ``near`` that join all rows it links; ``group`` tells and learns what is joined already."""
    found = []
    for k in np.flatnonzero(near.any(axis=1)):
        others, x = right[near[k]], left[k]
        new, first = np.unique(group[others], return_index=True)
        for y in others[first[new != group[x]]]:
            found.append((x, y))
            group[group == group[y]] = group[x]
    return found


def _blocks(block: pd.DataFrame, stored: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Places of two sets of rows, their cosines, and if the sets are one; by bounded parts, for each length of vectors."""
    for _, same in block.groupby("dim"):
        at = same["_at"].to_numpy()
        unit = _units(np.stack([np.frombuffer(v, stored) for v in same["vector"]]).astype(np.float64))
        home = np.flatnonzero((same["side"] == 0).to_numpy())
        alone = bool((block["side"] == 0).all() and block["block"].iloc[0] == block["block2"].iloc[0])
        away = home if alone else np.flatnonzero((same["side"] == 1).to_numpy())
        for i in range(0, len(home), BLOCK):
            for j in range(i if alone else 0, len(away), BLOCK):
                left, right = home[i : i + BLOCK], away[j : j + BLOCK]
                yield at[left], at[right], unit[left] @ unit[right].T, alone and i == j


def _tie(loose: float, stored: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_at=np.arange(len(rows)))
        reps, group, found = rows["rep"].to_numpy(), np.arange(len(rows)), []
        for left, right, cosine, one in _blocks(rows, stored):
            near = cosine >= loose
            found += _joined(np.triu(near, 1) if one else near, left, right, group)
        return pd.DataFrame([(reps[x], reps[y]) for x, y in found], columns=["u", "v"], dtype="int64")

    return run


def _compare(threshold: float, stored: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, block in rows.groupby(["cluster", "block", "block2"]):
            block = block.assign(_at=np.arange(len(block)))
            reps, weights = block["rep"].to_numpy(), block["weight"].to_numpy()
            group, links = np.arange(len(block)), np.zeros(len(block), np.int64)
            for left, right, cosine, one in _blocks(block, stored):
                near = cosine >= threshold
                near = np.triu(near, 1) if one else near
                # Whole numbers below 2^53 in double precision.
                links[left] += (near @ weights[right].astype(np.float64)).astype(np.int64)
                links[right] += (weights[left].astype(np.float64) @ near).astype(np.int64)
                found += [(int(reps[x]), int(reps[y]), 0) for x, y in _joined(near, left, right, group)]
            found += [(int(reps[k]), None, int(links[k])) for k in np.flatnonzero(links)]
        u, v, n = zip(*found, strict=True) if found else ((), (), ())
        return pd.DataFrame({"u": pd.array(u, "int64"), "v": pd.array(v, "Int64"), "n": pd.array(n, "int64")})

    return run


def _ties(classes: DataFrame, size: int, bits: int, window: int, loose: float, stored: str) -> DataFrame:
    """(``u``, ``v``): pairs that tie whatever may link into clusters."""
    places = _places(classes, bits).withColumn("rank", F.col("place") - F.col("pass") * F.lit(size))
    places = keep(places.select("rep", "pass", "run", F.col("rank")), "projection-ranks")
    own = F.floor(F.col("rank") / BLOCK).cast("long")
    # A block meets itself and the later ones within the window.
    last = max(0, (size - 1) // BLOCK)
    blocks = places.select("pass", own.alias("block")).distinct()
    until = F.least(F.floor(((F.col("block") + 1) * BLOCK - 1 + window) / BLOCK).cast("long"), F.lit(last))
    pairs = blocks.select("pass", "block", F.explode(F.sequence("block", until)).alias("block2"))
    sides = F.expr("if(block = block2, array(0), array(0, 1))")
    tasks = pairs.select("pass", "block", "block2", F.explode(sides).alias("side")).withColumn("own", F.expr("if(side = 0, block, block2)"))
    rows = places.select("rep", "pass", own.alias("own")).join(tasks, ["pass", "own"]).drop("own")
    dealt = rows.join(classes.select("rep", "dim", "vector"), "rep")
    near = dealt.groupBy("pass", "block", "block2").applyInPandas(_tie(loose, stored), "u long, v long")
    # Runs of equal keys that outgrow the window.
    runs = places.groupBy("pass", "run").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") > window)
    return near.unionByName(places.join(runs.drop("n"), ["pass", "run"]).select(F.col("rep").alias("u"), "v"))


def _links(classes: DataFrame, cluster: DataFrame, threshold: float, stored: str) -> DataFrame:
    """Links that join all linked classes (``u``, ``v``) and the numbers of links (``u``, ``n``): all pairs of a cluster."""
    sizes = keep(cluster.groupBy("component").agg(F.count(F.lit(1)).alias("rows")), "projection-sizes")
    last = F.floor((F.col("rows") - 1) / CLUSTER_ROWS)
    pairs = sizes.select("component", "rows", F.explode(F.sequence(F.lit(0), last)).alias("block"), last.alias("last"))
    pairs = pairs.select("component", "rows", "block", F.explode(F.sequence("block", "last")).alias("block2"))
    # Small clusters share a task, each pair of blocks of a large one has its own.
    small = sizes.where(F.col("rows") <= CLUSTER_ROWS).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    shared = F.pmod(F.xxhash64("component"), F.lit(4 * (1 + small // CLUSTER_ROWS)))
    pairs = pairs.withColumn("task", F.when(F.col("rows") <= CLUSTER_ROWS, shared).otherwise(F.xxhash64("component", "block", "block2")))
    sides = F.expr("if(block = block2, array(0), array(0, 1))")
    tasks = pairs.select("component", "task", "block", "block2", F.explode(sides).alias("side")).withColumn("own", F.expr("if(side = 0, block, block2)"))
    own = F.pmod(F.xxhash64("node"), F.floor((F.col("rows") - 1) / CLUSTER_ROWS) + 1)
    placed = cluster.join(sizes, "component").select(F.col("node").alias("rep"), "component", own.alias("own"))
    held = keep(placed.join(classes.select("rep", "dim", "vector", "weight"), "rep"), "projection-clusters")
    dealt = held.join(tasks, ["component", "own"]).drop("own").withColumnRenamed("component", "cluster")
    return keep(dealt.groupBy("task").applyInPandas(_compare(threshold, stored), "u long, v long, n long"), "projection-links")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, bits: int = BITS, window: int = WINDOW, seed: int = 7
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vec_id``, ``embedding``.

    Vectors that are null, empty, all zero, or hold null or non-finite components link with nothing. Vectors of other
    lengths never link with each other. Rows that repeat a vector are linked with each other. A null vec_id has neither
    links nor component; rows of one vec_id with different vectors share a component. Empty in, empty out. ``passes`` is
    the least number of passes.
    """
    passes = passes_for(vectors.count(), threshold, passes, window)
    keyed = keep(_keys(vectors, passes, bits, seed), "projections")
    classes = keyed.groupBy("vector").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("dim").alias("dim"), F.first("keys").alias("keys")
    )
    # Two vectors of one vec_id may both be the least of their class: a digest names the class.
    classes = keep(classes.withColumn("rep", F.xxhash64("vector")), "projection-classes")
    size = classes.count()
    stored = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    loose = math.cos(min(math.pi, SLACK * math.acos(max(-1.0, min(1.0, threshold)))))
    cluster = components(_ties(classes, size, bits, window, loose, stored), "projection-ties")
    found = _links(classes, cluster, threshold, stored)
    ids = classes.select(F.col("rep").alias("u"), "id")
    counts = found.groupBy("u").agg(F.sum("n").alias("n"))
    named = found.where("v is not null").join(ids, "u").select(F.col("v").alias("u"), F.col("id").alias("a")).join(ids, "u")
    links = named.select(F.col("a").alias("u"), F.col("id").alias("v"))
    # Equal vectors under several ids, and one id with several vectors, tie their classes as well.
    member = keyed.select("vec_id", "vector").join(classes.select("vector", "id", "weight", F.col("rep").alias("u")), "vector")
    member = keep(member.select("vec_id", "u", "id", "weight"), "projection-members")
    ties = member.where("vec_id <> id").select(F.col("vec_id").alias("u"), F.col("id").alias("v"))
    group = components(links.unionByName(ties), "projection-components").select(F.col("node").alias("vec_id"), "component")
    linked = member.join(counts, "u", "left").groupBy("vec_id").agg(F.max(F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("_n"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked, "vec_id", "left").join(group, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
