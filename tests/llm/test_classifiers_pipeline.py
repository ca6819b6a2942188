import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from tabsight.llm import quality, secret_scan, toxicity

from .conftest import ODD
from .test_similarity import Union, shingle_set
from .test_text_scans import base_spans, entropy

INSULTS = ["loser", "idiot", "scum", "grumokel"]


def corpus(seed, count=400):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(100, 100 + count):
        words = [f"thin{rng.randrange(60)}g" if rng.random() < 0.3 else rng.choice("and the of er in on".split()) for _ in range(rng.randrange(20, 80))]
        toxic, good = rng.random() < 0.25, rng.random() < 0.7
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS[:3]) if i % 2 else INSULTS[3] + rng.choice("abcdef"))
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words for _ in range(8)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark, documents):
    rows, labels = corpus(3)
    return documents(rows + ODD), spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"), labels


def judge(frame, truth, threshold):
    rows = frame.collect()
    assert len(rows) == len(truth) + len(ODD)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return np.mean([a == b for a, b in held])


def test_toxicity_held_out(labelled):
    docs, labels, truth = labelled
    assert judge(toxicity.toxicity(docs, labels), {i: t for i, _, t in truth}, 0.5) >= 0.95


def test_toxicity_fit_holds_little_on_the_driver(spark, documents):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=9)) for _ in range(6_000)]
    docs = documents([(i, " ".join(rng.choices(words, k=300) + INSULTS[: i % 2 * 3])) for i in range(500)]).select("doc_id", "text").cache()
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, toxic int")
    texts = sum(len(r["text"]) for r in docs.collect())
    tracemalloc.start()
    try:
        _, weights = toxicity.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert weights["loser"] > 0 and peak < 4 * texts


def test_quality_held_out(labelled):
    docs, labels, truth = labelled
    assert judge(quality.quality(docs, labels), {i: q for i, q, _ in truth}, 0.3) >= 0.95


def test_quality_prices_equal_words_once(monkeypatch):
    """As many index vectors are made as there are different words and pairs, and sums are those of every single token."""
    texts = ["The cat sat. the CAT " * 3_000, None, "x x", "dog!!", "the, 12 34"]
    words = (["the", "cat", "x"], ["a", "B", "a again"])
    tokens, total = quality.Tokens(words), np.zeros(6 * quality.DIMENSIONS)
    owner, read = tokens.read(texts)
    asked, entries_of = [], quality.index_entries
    monkeypatch.setattr(quality, "index_entries", lambda hashes: asked.append(len(hashes)) or entries_of(hashes))
    quality.add_contexts(total, owner, read, (0, len(owner)), 0, 3)
    pooled = quality.pooled(texts, [np.zeros((3, quality.DIMENSIONS), np.float32)] * 2, tokens)
    assert sum(asked) < 200

    def vector(word):
        made = np.zeros(quality.DIMENSIONS)
        places, signs = entries_of(np.array([zlib.crc32(word.encode()) & 0x7FFFFFFF]))
        np.add.at(made, places[0], signs[0])
        return made

    plain = np.zeros((6, quality.DIMENSIONS))
    for number, text in enumerate(texts):
        split = (text or "").split()
        pairs = [quality.words_of_token(t) for t in split]
        shapes = [s + " again" if i and split[i] == split[i - 1] else s for i, (_, s) in enumerate(pairs)]
        for kind, own in enumerate(([w for w, _ in pairs], shapes)):
            vectors = {w: vector(w) for w in own}
            for i, word in enumerate(own):
                if word in words[kind]:
                    near = [j for j in range(max(0, i - 2), min(len(own), i + 3)) if j != i]
                    plain[3 * kind + words[kind].index(word)] += sum((vectors[own[j]] for j in near), np.zeros(quality.DIMENSIONS))
            mean = sum((vectors[w] for w in own), np.zeros(quality.DIMENSIONS)) / max(len(own), 1)
            begin = (2 * kind + 1) * quality.DIMENSIONS
            assert np.allclose(pooled[number, begin : begin + quality.DIMENSIONS], mean, atol=1e-6)
    assert (total.reshape(6, -1) == plain).all()


@pytest.mark.parametrize("token, words", [("The", ("the", "B")), ("RESTING!!!", ("resting", "A!!")), ("\u0130X!!", ("ix", "A!!")), ("\u0130X!", ("i\u0307x", "A!")), ("a1b22", ("ab", "a9a9")), ("--", ("", "--"))])
def test_words_of_token(token, words):
    assert quality.words_of_token(token) == words


def test_without_rows_or_labels(spark, documents, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(none, no_labels).count() == 0 and quality.quality(none, no_labels).count() == 0
    rows = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents([(1, "you idiot, worthless scum"), (2, "a fine day"), (3, None)]), no_labels).collect()}
    assert rows[1] > 0.5 > max(rows[2], rows[3])
    assert {r["score"] for r in quality.quality(documents(ODD), no_labels).collect()} == {0.5}


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    rate = np.linspace(0.3, 0.9, len(toxicity.VOTERS))
    votes = np.where(y[:, None], rng.random((len(y), len(rate))) < rate, rng.random((len(y), len(rate))) < 0.05)
    masks, counts = np.unique(votes @ (1 << np.arange(len(rate))), return_counts=True)
    known = np.zeros((len(masks), 2))
    first = votes[:200] @ (1 << np.arange(len(rate)))
    for m, label in zip(first, y[:200], strict=True):
        known[np.searchsorted(masks, m), int(label)] += 1
    model = toxicity.LabelModel(masks, counts.astype(float), known)
    assert np.abs(model.rate[1] - rate).max() < 0.08 and abs(model.prior - 0.2) < 0.03


def test_temperature_is_fitted():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 5))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    network = quality.Network(x, (rng.random(4000) < p).astype(float))
    got = network.probability(x)
    for low in (0.1, 0.3, 0.5, 0.7):
        own = (got >= low) & (got < low + 0.2)
        assert abs(p[own].mean() - got[own].mean()) < 0.1


def test_pipeline_stages(spark, documents, tmp_path):
    import corpus_pipeline

    rows, labels = corpus(8, 200)
    token = "token=0123456789abcdef0123456789abcdef"
    rows = [*rows, (900, rows[0][1]), (901, f"{rows[1][1]} {token}"), (902, None), (903, "")]
    docs = documents(rows).drop("score")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), docs.schema)
        seen.append({r["doc_id"]: r["text"] for r in now.collect()})
    toxic = {i for i, _, t in labels if t}
    assert len(toxic - set(seen[0])) >= 0.9 * len(toxic) and len({i for i, _, t in labels if not t} - set(seen[0])) <= 2
    assert 900 not in seen[1] or rows[0][0] not in seen[0]
    assert set(seen[2]) == set(seen[1]) and not any("0123456789abcdef" in (t or "") for t in seen[2].values())
    assert set(seen[3]) <= set(seen[2])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(seen[3])


# --- the pipeline against plain Python ------------------------------------------------------------------------------


def plain_toxicity(rows, intercept, weights):
    def score(text):
        found = {f for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for f in [w, *(w[:k] + "*" for k in (4, 5, 6, 7) if len(w) > k)]}
        return intercept + sum(weights.get(f, 0.0) for f in sorted(found))

    return [r for r in rows if score(r[1]) < 0]


def plain_keep_one(rows):
    """Of each group of linked texts the row of the smallest doc_id; of equal rows without words one."""
    sets, union = [shingle_set(text, 5) for _, text, _ in rows], Union()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                union.join(i, j)
    groups = {}
    for i, (row, own) in enumerate(zip(rows, sets)):
        groups.setdefault(union.find(i) if own else row[:2], []).append(row)
    return [min(own, key=lambda r: r[0]) for own in groups.values()]


def plain_redact(text):
    spans = [(a, b) for a, _, _, b in base_spans(text)]
    for pattern, least in secret_scan.CLASSES.values():
        found = []
        for m in re.finditer(pattern, text):
            mixed = re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not re.search(secret_scan.ALLOW.replace("(?i)example|placeholder", "(?i:example|placeholder)"), m[0])
            if mixed and entropy(m[0]) >= least and not any(a < m.end() and m.start() < b for a, b in spans):
                found.append(m.span())
        spans += found
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def plain_copies(rows):
    """How often each row is drawn: the Poisson distribution of its source's rate, inverted at its hash."""
    sizes, md5 = Counter(r[2] for r in rows), lambda text: hashlib.md5(text.encode()).hexdigest()
    copies = Counter()
    for i, text, source in rows:
        rate = 1.0 / len(sizes) * len(rows) / sizes[source]
        u = int(md5(f"0:{i}:{md5(text or '')}:1")[:13], 16) / 16.0**13
        k, term = 0, np.exp(-rate)
        total = term
        while total <= u:
            k += 1
            term *= rate / k
            total += term
        copies[i, text] += k
    return +copies


def test_pipeline_equals_plain_python(spark, documents, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(12)
    plain, labels = corpus(12, 160)
    texts = [(i, text, rng.choice(["a", "a", "a", "b", "c"])) for i, text in plain]
    for k in range(40):  # near and exact copies
        words = rng.choice(texts)[1].split(" ")
        if k % 2:
            words[rng.randrange(len(words))] = f"new{k}"
        texts.append((1000 + k, " ".join(words), "b"))
    texts += [(2000, f"{plain[1][1]} token=abcdef123 deadbeefdeadbeefdeadbeef99", "c"), (2001, "", "a"), (2002, None, "c"), (2003, "key Zx8Kq2Vw9Lp4Tn7Rb3Yd6Hm1 " * 3, "a"), (2004, "many words here " * 3000, "c")]
    documents(texts).drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    want = plain_toxicity(texts, *toxicity.fit(docs.select("doc_id", "text"), truth))
    want = [(i, plain_redact(text) if text else text, source) for i, text, source in plain_keep_one(want)]
    copies = plain_copies(want)
    assert len(want) < len(texts) - 60 and sum(copies.values()) > 60

    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in now.collect()) == copies

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1 for i, text in copies}
    pieces, sequences, starts = corpus_pipeline.run(spark, str(tmp_path)).collect(), {}, {}
    for r in pieces:
        assert r["doc_tokens"] == lengths[r["doc_id"]]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        starts.setdefault(r["doc_id"], Counter())[r["start"], r["length"]] += 1
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    for (i, _), n in copies.items():
        at = 0
        for (start, length), times in sorted(starts.pop(i).items()):
            assert start == at and times == n
            at += length
        assert at == lengths[i]
    assert not starts

