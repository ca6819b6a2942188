import random
import re

import numpy as np
import pytest

from tabsight.llm import jaccard, near_dedup, top_k
from tabsight.llm.common import components

from .conftest import ODD


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(9, 9), (None, 3)]
    union = Union()
    for a, b in edges:
        if a is not None and a != b:
            union.join(a, b)
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: union.find(x) for x in list(union)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def similar_rows(seed, count=300):
    """Groups of copies with a few words changed, all sharing one common passage."""
    rng, rows = random.Random(seed), []
    passage = " ".join(f"common{i}" for i in range(30))
    for i in range(count):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(2000)}"
        else:
            words = [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(3, 160))] + passage.split(" ") * (rng.random() < 0.5)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("percent", "n"), [(90, 3), (80, 5)])
def test_jaccard_components_equal_brute_force(documents, percent, n, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 20)  # several blocks a cluster
    rows = similar_rows(percent) + [(1000, "A  b\tC"), (1001, "a B c"), (1002, "a b")]
    sets = {i: shingle_set(t, n) for i, t in rows}
    union = Union()
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                union.join(i, j)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(documents(rows), percent, n).collect()}
    assert got == {i: (len(s), union.find(i)) for i, s in sets.items()}
    assert len({c for _, c in got.values()}) < len(rows) - 20


def test_jaccard_odd_rows(odd, none):
    got = sorted((tuple(r) for r in jaccard.jaccard_components(odd).collect()), key=str)
    by_id = {i: (n, c) for i, n, c in got}
    assert len(got) == len(ODD) and by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3)
    assert by_id[5] == (2, 5) and by_id[6] == (2, 5) and by_id[None] == (1, None)
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.keep_one(odd)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in ODD if i != 6) and kept.columns == odd.columns


def test_keep_one_keeps_one_row_of_each_group(documents):
    text, clean = " ".join(f"w{i}" for i in range(60)), " ".join(f"clean{i}" for i in range(60))
    rows = [(5, text), (5, text), (5, text), (8, f"{text} more"), (8, clean), (9, "one of its own here"), (9, "one of its own here"), (10, None), (10, None), (10, ""), (None, clean)]
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(documents(rows)).collect()), key=str)
    assert got == sorted([(5, text), (8, clean), (9, "one of its own here"), (10, None), (10, ""), (None, clean)], key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def clustered(seed, groups=12, size=14, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, size))):
            rows.append((centre + rng.standard_normal(dim) * 0.12).astype(np.float32))
    rows += [rows[0], rows[0], rows[3] * 2]
    return [(int(i), [float(x) for x in v], 0) for i, v in enumerate(rows)]


BAD = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, [float("inf")] + [1.0] * 15, 1), (906, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = clustered(4)
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    links, union = dict.fromkeys(good, 0), Union()
    for i in good:
        for j in good:
            if i < j and good[i] @ good[j] >= 0.95:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    got = {r["vec_id"]: r for r in near_dedup.near_duplicates(vectors(spark, rows + BAD), window=24).collect()}
    assert set(got) == set(good) | {b[0] for b in BAD}
    assert all(got[i]["n_links"] <= n for i, n in links.items())
    assert sum(got[i]["n_links"] for i in good) >= 0.9 * sum(links.values()) > 0
    assert all(got[i]["component_id"] == union.find(i) and got[i]["kept"] == (union.find(i) == i) for i in good)
    assert all((got[i]["n_links"], got[i]["component_id"]) == (0, i) for i, _, _ in BAD)
    assert near_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Near, not equal vectors: a group far larger than the window, beside others, and some on its edge."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "CLUSTER_ROWS", 100, raising=False)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(32)
    hot = centre + rng.standard_normal((600, 32)) * 0.2 * np.linalg.norm(centre) / np.sqrt(32)
    data = np.concatenate([hot, rng.standard_normal((900, 32))]).astype(np.float32)
    unit = data.astype(np.float64) / np.linalg.norm(data.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    union = Union()
    for a, b in zip(*np.nonzero(near), strict=True):
        union.join(int(a), int(b))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(data)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_dedup.near_duplicates(vectors(spark, rows), window=16).collect()}
    assert near[:600, :600].sum() > 0.5 * 600 * 600
    assert got == {i: (int(near[i].sum()), union.find(i)) for i in range(len(data))}


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 40)
    monkeypatch.setattr(top_k, "QUERY_ROWS", 3)
    monkeypatch.setattr(top_k, "LEAF_ROWS", 4)
    rows = clustered(5)
    held = top_k.quantized(vectors(spark, rows + BAD))
    got = {}
    for r in top_k.top_k(held, held.where("vec_id % 5 = 0"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(np.array(v, np.float64) * 64).astype(np.int64) for i, v, _ in rows}
    whole[902] = np.zeros(16, np.int64)
    for q in [i for i in whole if i % 5 == 0]:
        best = sorted(((-int(whole[i] @ whole[q]), i) for i in whole if i != q))[:7]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    empty = top_k.quantized(vectors(spark, []))
    assert top_k.top_k(empty, empty).count() == 0


def test_fewer_than_k(spark):
    held = top_k.quantized(vectors(spark, [(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [0.5, 0.5], 0)]))
    rows = [tuple(r) for r in top_k.top_k(held, held.where("vec_id = 0")).orderBy("rank").collect()]
    assert rows == [(0, 1, 1, 64 * 64 * 5), (0, 2, 2, 64 * 32 * 3)]


def test_top_k_counts_distinct_ids(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 60)
    monkeypatch.setattr(top_k, "LEAF_ROWS", 4)
    rows = clustered(6)
    own = {i: [v] for i, v, _ in rows}
    for i in (0, 1, 2, 10):  # other vectors of the same ids: candidates and queries
        own[i].append(rows[i + 20][1])
    table = [(i, v, 0) for i, group in own.items() for v in group] * 25
    held = top_k.quantized(vectors(spark, table))
    got = {}
    for r in top_k.top_k(held, held.where("vec_id % 5 = 0"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [np.floor(np.array(v, np.float64) * 64).astype(np.int64) for v in group] for i, group in own.items()}
    for q in [i for i in whole if i % 5 == 0]:
        best = sorted((-max(int(a @ b) for a in whole[i] for b in whole[q]), i) for i in whole if i != q)[:7]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q


def test_ball_tree_with_negative_and_large_scores():
    rows = np.full((10, 1), -1000, np.int64)
    rows[[4, 7, 8, 9]] = -2000
    tree = top_k.BallTree(rows, np.arange(10), leaf=1)
    query = np.array([5000], np.int64)
    assert tree.search(query, -1, tree.bounds(query[None])[0], 1) == [(-5_000_000, 0)]
    rng = np.random.default_rng(9)
    for scale in (1, 1e3, 1e7):
        rows = np.floor(rng.normal(-3, 1, (300, 6)) * scale).astype(np.int64)
        rows[50:100] = rows[:50]
        ids = np.arange(300)
        tree = top_k.BallTree(rows, ids, leaf=4)
        for query in np.floor(rng.normal(3, 1, (20, 6)) * scale).astype(np.int64):
            best = sorted(((s, -i) for s, i in zip((rows @ query).tolist(), ids.tolist())), reverse=True)[:5]
            assert sorted(tree.search(query, -1, tree.bounds(query[None])[0], 5), reverse=True) == best
