"""Exact Jaccard self-join of word n-gram sets by prefix trees.

Sets are stored in one global order (that of a 64-bit hash of the n-gram). Equal sets are one class.

1. Filter. Two linked sets share at least k elements among the first |x| - o(x) + k of each, where o(x) is the least
   overlap that x can have with a partner. Only these prefixes are shuffled: an element that no other class has there
   cannot be shared, and a class with too few others is linked with nothing. Most texts go here.
2. Blocks. The classes left are tied by elements of their short prefixes (k = 1), now in the order of rarity, into
   clusters; linked classes are always in one cluster. A cluster is cut into blocks of bounded size along the set size,
   and only pairs of blocks whose sizes can be similar are compared.
3. Trees. In a task the sets of a block stand in a prefix tree; the sets of the other block walk it, subtrees share
   the overlap counted so far, and a subtree is left as soon as what remains on either side cannot reach the overlap
   needed. Sets that are in one component already are passed over, so a group of copies costs no pair of each two.

Hashes of 64 bits stand for n-grams: two n-grams of one pair of sets clash with a probability of about 1e-13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.llm.common import components, keep, own_names, python_tasks, quoted

#: Classes of one block, and elements of one block at most: what a task holds.
BLOCK_ROWS, BLOCK_ELEMENTS = 600, 120_000
#: So many ids of classes (some 100 MB) may be broadcast to find their texts; more are found by a shuffle.
BROADCAST_IDS = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(20240607).integers(1, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Long texts are hashed by pieces of this many bytes.
_POWERS = np.full(1 << 16, _BASE, np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word: runs of bytes other than the six ASCII white spaces, A-Z in lower case."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return np.empty(0, np.uint64)
    # Each byte's number times a power of its place in the word, summed over the word.
    place = np.arange(len(data))
    place[begin[0] :] -= np.repeat(begin, np.diff(np.append(begin, len(data))))
    powers = _POWERS[place & 0xFFFF] + (place >> 16).astype(np.uint64)
    terms = np.where(inside[1:-1], _BYTES[data] * powers, np.uint64(0))
    return _mix(np.add.reduceat(terms, begin) + (end - begin).astype(np.uint64))


def shingles(text: str | None, n: int = 3) -> np.ndarray:
    """The ordered set of a text's word n-grams; with fewer words the whole sequence is one; without words none."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = _mix(total * _BASE + words[k : len(words) - n + 1 + k])
    return np.unique(total + np.uint64(n))


def _least(size, percent: int):
    """Least overlap with any partner: ceil(percent / 100 * size)."""
    return -(-size * percent // 100)


def _short(size, percent: int):
    """Elements of which two linked sets share one."""
    return size - _least(size, percent) + 1


def _shared(size, percent: int):
    """k: so many elements two linked sets share among the first _short + k - 1 of each."""
    return _short(size, percent)


_SETS = "doc_id long, text_hash long, size long, sig1 long, sig2 long, elements array<long>"


def _text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def _sets(docs: DataFrame, n: int, percent: int, whole: bool) -> DataFrame:
    """``doc_id``, ``text_hash``, ``size``, two numbers over the whole set, and its elements: the long prefix, or all."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, text_hash in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingles(text, n)
                size = len(found)
                part = found if whole or not size else found[: _short(size, percent) + _shared(size, percent) - 1]
                one, two = _mix(found).sum(dtype=np.uint64), _mix(found ^ _BASE).sum(dtype=np.uint64)
                rows.append((doc_id, text_hash, size, int(one.view(np.int64)), int(two.view(np.int64)), part.view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
            names = [c.split()[0] for c in _SETS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash().alias("text_hash"))
    return rows.mapInArrow(run, _SETS)


class _Node:
    """A run of elements (``path``) after ``at`` others; the sets that end here, and the sizes of all sets below."""

    __slots__ = ("at", "big", "ends", "path", "small", "sub")

    def __init__(self, path: np.ndarray, at: int):
        self.path, self.at, self.sub, self.ends, self.small, self.big = path, at, {}, [], 1 << 60, 0


class PrefixTree:
    """Sets of ascending numbers in a tree that shares common beginnings."""

    def __init__(self):
        self.root = _Node(np.empty(0, np.int64), 0)

    def add(self, elements: np.ndarray, row: int) -> None:
        node, at, size = self.root, 0, len(elements)
        node.small, node.big = min(node.small, size), max(node.big, size)
        while at < size:
            key = int(elements[at])
            sub = node.sub.get(key)
            if sub is None:
                sub = node.sub[key] = _Node(elements[at:], at)
                same = size - at
            else:
                run = min(len(sub.path), size - at)
                differ = np.flatnonzero(sub.path[:run] != elements[at : at + run])
                same = int(differ[0]) if len(differ) else run
                if same < len(sub.path):  # split the edge
                    upper = _Node(sub.path[:same], at)
                    upper.small, upper.big = sub.small, sub.big
                    sub.path, sub.at = sub.path[same:], at + same
                    upper.sub[int(sub.path[0])] = sub
                    node.sub[key] = sub = upper
            sub.small, sub.big = min(sub.small, size), max(sub.big, size)
            node, at = sub, at + same
        node.ends.append(row)

    def walk(self, probes: list[np.ndarray], shared: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(row, probes linked with it) for every row that has any. All probes walk together, each subtree is left by
        those that can no longer reach the overlap they need. ``shared`` tells of each element if several sets have it."""
        size = np.array([len(p) for p in probes], np.int64)
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        elements = len(shared)
        flat = np.concatenate([p + i * elements for i, p in enumerate(probes)])
        place = np.cumsum(shared) - 1
        holds = np.zeros((int(shared.sum()), len(probes)), bool)
        for i, p in enumerate(probes):
            holds[place[p[shared[p]]], i] = True
        least = _least(size, percent)
        stack = [(self.root, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while stack:
            node, live, overlap = stack.pop()
            depth = node.at + len(node.path)
            left = size[live]
            if len(node.path):
                overlap = overlap + holds[place[node.path[shared[node.path]]]][:, live].sum(0)
                passed = np.searchsorted(flat, live * elements + node.path[-1], side="right")
                left = left - (passed - begin[live])
            small = np.maximum(node.small, least[live])
            best = overlap + np.minimum(left, node.big - depth)
            fits = (small <= node.big) & (small * percent <= 100 * size[live]) & (100 * best >= percent * (size[live] + small - best))
            live, overlap = live[fits], overlap[fits]
            if not len(live):
                continue
            if node.ends:
                linked = live[100 * overlap >= percent * (size[live] + depth - overlap)]
                if len(linked):
                    for row in node.ends:
                        yield row, linked
            stack.extend((sub, live, overlap) for sub in node.sub.values())


def spanning_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that join all linked sets of two blocks (of one, if ``right`` is None): no more than that needs.

    Rows of ``right`` are numbered after those of ``left``. Links inside a block are not looked for if there are two.
    """
    sets = [*left, *(right or ())]
    if not left or len(sets) < 2:
        return []
    _, numbers, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    numbered = np.split(numbers.astype(np.int64), np.cumsum([len(s) for s in sets])[:-1])
    tree, first = PrefixTree(), 0 if right is None else len(left)
    for row in range(len(left)):
        tree.add(numbered[row], row)
    group, links = np.arange(len(sets)), []
    for row, linked in tree.walk(numbered[first:], times > 1, percent):
        for probe in linked + first:
            if group[probe] != group[row]:
                links.append((row, int(probe)))
                group[group == group[probe]] = group[row]
    return links


def _compare(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, block in rows.groupby(["cluster", "block", "block2"]):
            block = block.sort_values(["side", "rep"])
            sets = [np.asarray(e, np.int64).view(np.uint64) for e in block["elements"]]
            first = int((block["side"] == 0).sum())
            names = block["rep"].to_numpy()
            links += [(names[a], names[b]) for a, b in spanning_links(sets[:first], sets[first:] or None, percent)]
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def class_links(docs: DataFrame, sets: DataFrame, percent: int = 90, n: int = 3, rep: str = "doc_id") -> DataFrame:
    """(``u``, ``v``): links between class representatives that join all linked ones.

    ``rep``: the column that stands for a class; its smallest doc_id, or ``sig1``, which keeps texts of one doc_id apart.

    ``sets``: what ``_sets`` gives for the rows that have a set and a doc_id, written to a table.
    """
    # 1. Elements of long prefixes that only one class has; a class needs others for as many as its smallest partner.
    elements = sets.select("sig1", F.explode("elements").alias("e"))
    alone = elements.groupBy("e").agg(F.min("sig1").alias("sig1"), F.max("sig1").alias("last")).where("sig1 = last")
    own = alone.groupBy("sig1").agg(F.count(F.lit(1)).alias("own"))
    short = f"size - ceil(size * {percent} / 100) + 1"
    partner = F.expr(f"ceil(size * {percent} / 100)")
    needed = F.expr(f"partner - ceil(partner * {percent} / 100) + 1")
    left = (
        sets.select("doc_id", "sig1", "sig2", "size", F.size("elements").alias("long")).join(own, "sig1", "left")
        .withColumn("partner", partner).where(F.col("long") - F.coalesce("own", F.lit(0)) >= needed)
        .groupBy("sig1", "sig2", "size").agg(F.min("doc_id").alias("doc_id"))
    )
    left = keep(left.select("doc_id", "sig1"), "jaccard-left")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = F.broadcast(left) if left.count() <= BROADCAST_IDS else left
    texts = texts.join(ids.select("doc_id"), "doc_id", "left_semi")
    whole = _sets(texts, n, percent, True).join(ids, ["doc_id", "sig1"], "left_semi").dropDuplicates(["doc_id", "sig1"])
    whole = keep(whole.select(F.col(rep).alias("rep"), "size", "elements"), "jaccard-whole")
    # 2. The short prefix again, now of whole sets in the order of rarity: what no other class has comes first and ties
    # nothing. Each element ties the classes that have it in their short prefix to the smallest of them.
    every = whole.select("rep", "size", F.explode("elements").alias("e"))
    times = every.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = every.join(times, "e").groupBy("rep", "size").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("shared"))
    place = F.expr(f"cast({short} - (size - size(shared)) as int)")
    rare = shared.withColumn("place", place).where("place > 0").select("rep", F.explode(F.expr("slice(shared.e, 1, place)")).alias("e"))
    rare = keep(rare, "jaccard-rare")
    centre = rare.groupBy("e").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v <> last").select("e", "v")
    ties = rare.join(centre, "e").select(F.col("rep").alias("u"), "v").where("u <> v").distinct()
    cluster = components(ties, "jaccard-ties").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    # Blocks along the size. The window goes over the distinct sizes of a cluster; rows of one size get places by hash.
    members = whole.select("rep", "size").join(cluster, "rep")
    sizes = members.groupBy("cluster", "size").agg(F.count(F.lit(1)).alias("n"))
    smaller = W.partitionBy("cluster").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        "cluster", "size", "n", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") * F.col("size")).over(smaller), F.lit(0)).alias("filled")
    )
    at = F.pmod(F.xxhash64("rep"), F.col("n"))
    block = F.floor((F.col("rows") + at) / BLOCK_ROWS) + F.floor((F.col("filled") + at * F.col("size")) / BLOCK_ELEMENTS)
    ranked = members.join(sizes, ["cluster", "size"]).select("rep", "size", "cluster", block.cast("long").alias("block"))
    ranked = keep(ranked, "jaccard-blocks")
    blocks = ranked.groupBy("cluster", "block").agg(F.min("size").alias("small"), F.max("size").alias("big"), F.count(F.lit(1)).alias("n"))
    other = blocks.select("cluster", F.col("block").alias("block2"), F.col("small").alias("small2"), F.col("n").alias("n2"))
    pairs = blocks.join(other, "cluster").where(f"block <= block2 and 100 * big >= {percent} * small2 and (block < block2 or n > 1)")
    sides = F.expr("if(block = block2, array(0), array(0, 1))")
    tasks = pairs.select("cluster", "block", "block2", F.explode(sides).alias("side")).withColumn("own", F.expr("if(side = 0, block, block2)"))
    # 3. Small clusters share a task, the pairs of blocks of large ones are spread.
    total = ranked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wanted = ranked.select("rep", "cluster", F.col("block").alias("own"))
    dealt = whole.join(wanted, "rep").join(tasks, ["cluster", "own"])
    buckets = max(1, total // BLOCK_ELEMENTS) * 4
    rows = dealt.select("rep", "elements", "cluster", "block", "block2", "side").withColumn(
        "bucket", F.pmod(F.xxhash64("cluster", "block", "block2"), F.lit(buckets))
    )
    return rows.groupBy("bucket").applyInPandas(_compare(percent), "u long, v long")


def jaccard_components(docs: DataFrame, percent: int = 90, n: int = 3) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row: the smallest doc_id reachable by links.

    Two texts link when 100 * intersection >= percent * union of their n-gram sets; equal sets always do. Null, empty
    and wordless texts have no set and stand alone, as do rows without doc_id. Rows that share a doc_id count as one
    node, each with its own text's links. Repeated rows come back repeated; an empty table gives an empty result.
    """
    prefixed = keep(_sets(docs, n, percent, False), "jaccard-sets")
    named = prefixed.where("size > 0 and doc_id is not null")
    links = class_links(docs, named, percent, n)
    linked = components(links, "jaccard-components").select(F.col("node").alias("rep"), "component")
    classes = named.groupBy("sig1", "sig2", "size").agg(F.min("doc_id").alias("rep"))
    ids = classes.join(linked, "rep", "left").select("sig1", "sig2", "size", F.coalesce("component", "rep").alias("component"))
    member = prefixed.select("doc_id", "size", "sig1", "sig2").join(ids, ["sig1", "sig2", "size"], "left")
    alone = F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return member.select("doc_id", F.col("size").alias("n_shingles"), alone.alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 90, n: int = 3) -> DataFrame:
    """One row of ``docs`` for each group of linked texts: that of the smallest doc_id, then of the smallest text hash.

    Texts are linked as such: rows that share a doc_id and hold different texts are apart. Texts without words link with
    nothing; of each doc_id and text one row stays. Rows without doc_id all stay. Other columns pass through, whatever
    their names.
    """
    sets = keep(_sets(docs, n, percent, False), "jaccard-sets").where("doc_id is not null")
    named = sets.where("size > 0")
    linked = components(class_links(docs, named, percent, n, "sig1"), "jaccard-components")
    linked = linked.select(F.col("node").alias("sig1"), "component")
    rows = named.groupBy("sig1", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).join(linked, "sig1", "left")
    named = rows.groupBy(F.coalesce("component", "sig1")).agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("first")).select("first.*")
    alone = sets.where("size = 0").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    ident, hashed, times = own_names(docs, "own_id", "own_hash", "own_times")
    stays = keep(named.unionByName(alone), "jaccard-stays").toDF(ident, hashed, times)
    own = docs.where("doc_id is not null").withColumns({ident: F.col("doc_id").cast("long"), hashed: _text_hash()})
    key = [ident, hashed]
    once = own.join(stays.where(F.col(times) == 1), key, "left_semi")
    repeated = own.join(stays.where(F.col(times) > 1), key, "left_semi").dropDuplicates(key)
    return once.unionByName(repeated).select(*map(quoted, docs.columns)).unionByName(docs.where("doc_id is null"))
