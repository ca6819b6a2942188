"""Exact top-k by integer inner product: ball trees per shard, branch and bound.

Candidates are dealt into shards of bounded size, queries into blocks of bounded size, and every query block meets
every shard: a stated query set against all rows, in blocks. In a task the shard becomes a tree of balls; a query opens
nodes by the upper bound of the inner product in a ball (centre product plus radius times the query's length) and stops
once no bound reaches its kth score. The first wave meets one shard; the kth scores found there are shared with all
other shards, which start from them and return only candidates that can still be among the first k. Results are counted by vec_id:
repeated rows are dropped before the search, and several vectors of one vec_id are one result, with its best score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.llm.common import keep, python_tasks

K, SCALE = 20, 64
NO_SCORE = -(1 << 62)
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8192, 1024, 64


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``dim``, ``vector`` (bytes of 8-byte integers): floor(scale * x), x as a double.

    Vectors that are null or empty or hold null or non-finite components are left out, as are rows without vec_id.
    """
    python_tasks(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vec_id is None or not vector or None in vector:
                    continue
                row = np.floor(np.array(vector, np.float64) * scale)
                if np.isfinite(row).all():
                    rows.append((vec_id, len(row), row.astype(np.int64).tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["vec_id", "dim", "vector"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, dim int, vector binary")


class BallTree:
    """Nodes over rows ``order[begin:end]``; split at the median along the line between two far rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(rows))
        self.begin, self.end, self.sub, centres, radii = [], [], [], [], []
        real = rows.astype(np.float64)

        def build(begin: int, end: int) -> int:
            node = len(self.begin)
            own = real[self.order[begin:end]]
            centre = own.mean(axis=0)
            apart = own - centre
            far = (apart * apart).sum(axis=1)
            self.begin.append(begin), self.end.append(end), self.sub.append(None)
            centres.append(centre), radii.append(float(np.sqrt(far.max())))
            if end - begin > leaf and far.max() > 0:
                one = own[far.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                middle = (end - begin) // 2
                halves = np.argpartition(own @ (other - one), middle)
                self.order[begin:end] = self.order[begin:end][halves]
                self.sub[node] = (build(begin, begin + middle), build(begin + middle, end))
            return node

        build(0, len(rows))
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.rows, self.ids = rows[self.order], ids[self.order]
        self.repeated = len(np.unique(ids)) < len(ids)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No row of a node scores more; scores are whole numbers, so bounds are rounded down (with a little slack)."""
        real = queries.astype(np.float64)
        length = np.sqrt((real * real).sum(axis=1))
        bounds = real @ self.centres.T + length[:, None] * self.radii
        # What rounding may have lost grows with the parts of the sum, which can cancel each other.
        parts = length[:, None] * (np.sqrt((self.centres * self.centres).sum(axis=1)) + self.radii)
        return np.floor(bounds + parts * 1e-9 + 1e-3)

    def search(self, query: np.ndarray, own_id: int, bounds: np.ndarray, k: int, least: int = NO_SCORE) -> list[tuple[int, int]]:
        """(score, -id) of up to k best ids other than the query's own, each with its best row, none below ``least``."""
        best: list[tuple[int, int]] = []
        score_of: dict[int, int] = {}  # of the ids in best
        kth = least
        open_nodes = [(-bounds[0], 0)]
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            if -bound < kth:
                break
            if self.sub[node]:
                for sub in self.sub[node]:
                    if bounds[sub] >= kth:
                        heapq.heappush(open_nodes, (-bounds[sub], sub))
                continue
            part = slice(self.begin[node], self.end[node])
            scores = self.rows[part] @ query
            ids = self.ids[part]
            fits = (scores >= kth) & (ids != own_id)
            scores, ids = scores[fits], ids[fits]
            if self.repeated:
                order = np.lexsort((ids, -scores))
                first = order[np.unique(ids[order], return_index=True)[1]]
                scores, ids = scores[first], ids[first]
            if len(scores) > k:
                first = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[first], ids[first]
            for item in zip(scores.tolist(), (-ids).tolist(), strict=True):
                if item[1] in score_of:
                    old = (score_of[item[1]], item[1])
                    if item <= old:
                        continue
                    best.remove(old)
                    heapq.heapify(best)
                elif len(best) == k:
                    if item < best[0]:
                        continue
                    del score_of[heapq.heappop(best)[1]]
                heapq.heappush(best, item)
                score_of[item[1]] = item[0]
            if len(best) == k:
                kth = max(kth, best[0][0])
        return best


_FOUND = "query_id long, vec_id long, score long"


def _search(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        query = (rows["side"] == 0).to_numpy()
        asked, held = rows[query].sort_values("vec_id"), rows[~query].sort_values("vec_id")
        found = []
        if len(asked) and len(held):
            matrix = np.stack([np.frombuffer(v, np.int64) for v in held["vector"]])
            tree = BallTree(matrix, held["vec_id"].to_numpy())
            queries = np.stack([np.frombuffer(v, np.int64) for v in asked["vector"]])
            bounds = tree.bounds(queries)
            for row, (vec_id, least) in enumerate(zip(asked["vec_id"], asked["least"], strict=True)):
                best = tree.search(queries[row], vec_id, bounds[row], k, int(least))
                found += [(vec_id, -other, score) for score, other in best]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k best rows, ties to smaller ids.

    Both sides: ``vec_id``, ``dim``, ``vector`` as from ``quantized``. Rows meet only rows of their own length. A query
    with fewer than k candidates gets all of them; repeated ids are answered once each and are never their own answer.
    """
    rows = keep(vectors.dropDuplicates(["vec_id", "dim", "vector"]), "search-rows")
    asked = keep(queries.dropDuplicates(["vec_id", "dim", "vector"]), "search-queries")
    shards, blocks = max(1, -(-rows.count() // SHARD_ROWS)), max(1, -(-asked.count() // QUERY_ROWS))
    held = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))

    def wave(asked: DataFrame, first: int, last: int) -> DataFrame:
        all_shards = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("shard")
        left = asked.select("vec_id", "dim", "vector", "least", "block", F.lit(0).alias("side"), all_shards)
        right = held.where(F.col("shard").between(first, last)).select(
            "vec_id", "dim", "vector", F.lit(NO_SCORE).alias("least"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "shard"
        )
        return left.unionByName(right).groupBy("dim", "block", "shard").applyInPandas(_search(k), _FOUND)

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def first(found: DataFrame) -> DataFrame:
        unique = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return unique.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = keep(wave(asked.withColumn("least", F.lit(NO_SCORE)), 0, 0), "search-first")
    if shards > 1:
        kth = first(found).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        known = asked.join(kth, "vec_id", "left").fillna(NO_SCORE, "least")
        found = found.unionByName(wave(known, 1, shards - 1))
    # At most k rows of each shard for a vector of a query.
    return first(found).select("query_id", "rank", "vec_id", "score")
