import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabsight.llm import divergence, token_counts, vector_codes

from .conftest import LONG, ODD


def vectors_frame(spark, rows):
    data = [(*r, -1, "x", 0) for r in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, dim int, code string, part int").repartition(3)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """The contract in plain integers, for vectors of one length."""
    own = [(i, label, [math.floor(4096 * x) for x in v]) for i, v, label in rows if v is not None and None not in v and all(map(math.isfinite, v))]
    wide = len(own[0][2]) // parts
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for _, _, v in own]
    first = {}
    for (i, _, _), c in zip(own, cut):
        first.setdefault((i is None, i), c)
    start = [first[i] for i in sorted(first, key=lambda k: (k[0], k[1] or 0))][:entries]
    books = [[list(c[p]) for c in start] for p in range(parts)]

    def assign():
        found = []
        for c in cut:
            found.append([min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return found

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(column) // len(mine) for column in zip(*mine)]
    found = assign()
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, label, _), e in zip(own, errors):
        by_label[label] += e
    return sorted((((i is None, i), "".join(f"{k:02x}" for _, k in f), e, by_label[label], sha) for (i, label, _), f, e in zip(own, found, errors)), key=repr)


def got_codes(frame):
    return sorted((((r["vec_id"] is None, r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.vector_codes(frame).collect()), key=repr)


@pytest.mark.parametrize("scale", [0.3, 5e4, 3e38])
def test_vector_codes_equal_plain_integers(spark, scale):
    rng = random.Random(3)
    centres = [[rng.gauss(0, scale) for _ in range(16)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, scale / 9) for x in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, rows[9][1], 2), (400, None, 1), (401, [math.nan] * 16, 1), (402, [math.inf] + [0.0] * 15, 1), (403, [None] + [0.0] * 15, 1), (404, [0.0] * 16, None)]
    want = plain_codes(rows)
    if scale > 1e30:  # no long holds these errors
        want = sorted(((i, code, None, None, sha) for i, code, e, le, sha in want), key=repr)
    got = got_codes(vectors_frame(spark, rows))
    if scale > 1e30:
        got = sorted(((i, code, None, None, sha) for i, code, e, le, sha in got if e is None or e == 0), key=repr)
    assert got == want


def test_vector_codes_of_few_empty_and_mixed_lengths(spark):
    few = [(i, [float(i == k) for k in range(8)], 0) for i in range(3)]
    assert got_codes(vectors_frame(spark, few)) == plain_codes(few)
    assert vector_codes.vector_codes(vectors_frame(spark, [])).collect() == []
    long = [(10 + i, [i / 7] * 24, 1) for i in range(20)]
    mixed = got_codes(vectors_frame(spark, few + long + [(99, [1.0] * 9, 0)]))
    assert mixed == sorted(plain_codes(few) + plain_codes(long), key=repr)


def test_pivots_prune_without_loss():
    rng = np.random.default_rng(4)
    entries = np.floor(rng.normal(size=(16, 8)) * 900)
    rows = np.floor(entries[rng.integers(0, 16, 3000)] + rng.normal(size=(3000, 8)) * 60)
    pivots = entries[:4]
    known = vector_codes.pivot_distances(rows[:, None], pivots[None])[:, 0]
    best, least, evaluated = vector_codes.nearest(rows, known, entries, pivots)
    apart = ((rows[:, None] - entries) ** 2).sum(axis=2)
    assert (best == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()
    assert evaluated < 0.5 * 16 * len(rows)


# --- divergence ---------------------------------------------------------------------------------------------------


def plain_divergence(rows, least=3, ranks=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, counts = Counter(), defaultdict(Counter)
        for own_lang, source, words in docs:
            if own_lang == lang:
                df.update(set(words))
                counts[source].update(words)
        kept = [t for t, n in df.items() if n >= least]
        of_lang = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(of_lang)
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:ranks])):
                out += [(lang, s, part, item, -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def got_divergence(spark, rows, **limits):
    frame = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, source string, text string, n int, term string").repartition(3)
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.divergences(frame, **limits).collect())


@pytest.mark.parametrize("blocks", [(64, 1024), (3, 7)])
def test_divergences_equal_plain_python(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "BLOCK_GROUPS", blocks[0])
    monkeypatch.setattr(divergence, "BLOCK_TERMS", blocks[1])
    rng = random.Random(5)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "é", "日本", "ÀB", "x\U0001f600"]
    rows = [(rng.choice(["en", "de", None]), f"s{rng.randrange(8)}", " ".join(rng.choices(words[: rng.randrange(5, 95)], k=rng.randrange(30)))) for _ in range(220)]
    rows += [("en", None, None), ("en", "blank", " 12 \x00 "), ("xx", "one", "a b"), ("xx", "two", ""), ("yy", "alone", "a a b"), ("yy", "alone", "a c"), ("yy", "alone", "A"), ("en", "s1", "Only-Here only_here ONLY here"), ("de", "long", LONG)]
    rows += [("en", "s2", text) for _, text in ODD] + [rows[0]] * 4
    assert got_divergence(spark, rows, ranks=20) == plain_divergence(rows, ranks=20)


def test_divergences_of_an_empty_table(spark):
    assert got_divergence(spark, []) == []


def test_tree_prices_zero_quadrants():
    rng = np.random.default_rng(6)
    cells = rng.integers(1, 50, (11, 37)) * (rng.random((11, 37)) < 0.1)
    cells[4:8, 16:32] = 0
    rows, columns = np.nonzero(cells)
    totals = cells.sum(axis=1) + 40
    share = 1 + 1_000_000_000 * (cells + 1) // totals[:, None]
    want = np.array([[sum((share[a] - share[b]) ** 2 // share[b]) for b in range(11)] for a in range(11)])
    one_block = divergence.block_divergence(rows, columns, cells[rows, columns], totals, 37, np.zeros(11, int))
    assert (one_block == want).all()
    sides = np.array([0] * 4 + [1] * 7)
    two_blocks = divergence.block_divergence(rows, columns, cells[rows, columns], totals, 37, sides)
    assert (two_blocks == np.where(sides[:, None] != sides[None, :], want, 0)).all()


# --- token counts -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))


def odd_texts(seed, count):
    rng = random.Random(seed)
    letters = "a b's t'r e'l v' mdlrevst  \n\t1½2é一\U0001f600.,!' \x00\x85　<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(count)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 592), rng.randrange(0xD7FF), rng.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(count)]
    fixed = ["", " ", "  a", "it's 're 'r 'rx 've' ''s '''ll x's's a'sb 'Re  's\n's\t've12's", "<|endoftext|>a<|endoftext|><|endoftext|> b<|endoftext|", "a\n\n\nb \n c   ", "a" * 5000, "ab" * 3000, " " * 3000 + "x", "=" * 999, LONG]
    return texts + fixed


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_counts_equal_the_library(library, block):
    texts = odd_texts(block, 1500 if block > 100 else 300)
    counter = token_counts.TokenCounter(block=block)
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_full_table_starts_anew(library):
    texts = odd_texts(8, 200)
    counter = token_counts.TokenCounter()
    counter.machine.most = 300
    counter.machine.clear()
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunk_maps_compose(library):
    machine = token_counts.SplitMachine()
    codes = np.append(np.frombuffer(("it's  a'll\n\n x 12're " * 40).encode("utf-32-le"), np.uint32), np.uint32(token_counts.END))
    whole = machine.begins(codes, chunk=len(codes))
    for chunk in (1, 2, 7, 64):
        assert (machine.begins(codes, chunk=chunk) == whole).all()


def test_token_counts_of_odd_rows(odd, none, library):
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(odd.withColumnRenamed("score", "n_tokens")).collect())
    want = []
    for i, text in ODD:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((i or -1, len((text or "").encode()), n, n > 512))
    assert got == sorted(want)
    assert token_counts.token_counts(none).collect() == []
