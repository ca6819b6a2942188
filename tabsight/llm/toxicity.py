"""Toxic texts by weak supervision: many voters, a generative label model, and a linear classifier on its labels.

Voters are binary: word lists (some written down here, some drawn from labelled training rows) and patterns. Their votes
over the whole corpus are counted by vote pattern, at most 2**16 of them. The label model is a mixture of a toxic and a
clean class, fitted by expectation maximization on these counts, with the training labels as fixed members. It gives
each voter's rate in either class (its accuracy) and the correlations of voters: within a class, every voter depends on
the one it goes with most (the spanning tree of the largest mutual information), so that votes that repeat each other
count once. Posterior labels of a bounded, hash-chosen sample of all texts, labelled or not, train a sparse linear
classifier on the presence of words and word beginnings, which scores every whole text; known labels anchor the
posteriors of their own texts and no others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import own_names, python_tasks, quoted

# Word lists of the lexicon voters, public everyday insults by what they aim at.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile cretin fool brainless",
    "worth": "worthless useless loser losers failure pathetic nobody trash garbage rubbish scum filth vermin",
    "disgust": "disgusting gross vile repulsive revolting sickening filthy nasty hideous ugly",
    "mockery": "clown clowns joke ridiculous laughable freak weirdo creep pig rat",
    "hate": "hate hated despise loathe shut die kill hell damn",
    "vulgar": "crap bullshit bastard bitch asshole shit fuck fucking piss",
    "other_tongues": "idiota estupido estúpido imbécil basura asqueroso dummkopf blöd trottel abschaum wertlos crétin débile ordure minable",
}
_LISTS = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
#: Lists drawn from training rows, and the words or word beginnings of each.
DRAWN_LISTS, DRAWN_WORDS = 6, 40
#: Pattern voters: an insult after a word of address; several different ones; two of them close together.
PATTERNS = ("addressed", "several", "dense")
VOTERS = (*LEXICONS, *(f"drawn{k}" for k in range(DRAWN_LISTS)), *PATTERNS)
assert len(VOTERS) <= 16
ADDRESS = frozenset("you your he she they such du tu ihr usted".split())

#: Bounds of the fit: labelled rows of each class (distinct texts) that anchor the model and that lists are drawn from;
#: further texts, whatever their labels, that train the classifier by their posteriors alone; its features; and the
#: longest text, in characters, that is fitted on (every text is voted on and scored, whatever its length).
LABELLED_ROWS, SAMPLED_ROWS, FEATURES, FITTED_CHARS = 2_000, 3_000, 4096, 50_000
#: How far a known label is trusted against the votes, and the weight of a text with a sure posterior beside one with a
#: known label.
LABEL_ACCURACY, SAMPLE_TRUST = 0.98, 0.3
#: Word beginnings that count as features beside whole words: languages bend their insults.
BEGINNINGS = (4, 5, 6, 7)

_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


class _Corpus:
    """Texts as arrays of word numbers and the features of each word: some MB of the driver where sets of words and
    dictionaries of features take hundreds.

    Features are numbered: the words first, then the beginnings, which are runs of the sorted words.
    """

    def __init__(self, texts: Iterable[list[str]]):
        place: dict[str, int] = {}
        self.texts = [np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32) for words in texts]
        self.words = list(place)
        del place
        self.own = np.full((len(self.words), 1 + len(BEGINNINGS)), -1, np.int32)
        self.own[:, 0] = np.arange(len(self.words))
        order = sorted(range(len(self.words)), key=self.words.__getitem__)
        first: list[tuple[int, int]] = []
        for column, k in enumerate(BEGINNINGS, 1):
            last = None
            for i in order:
                if len(self.words[i]) > k:
                    if (beginning := self.words[i][:k]) != last:
                        last = beginning
                        first.append((i, k))
                    self.own[i, column] = len(self.words) + len(first) - 1
        self.first = np.array(first, np.int32).reshape(-1, 2)
        self.size = len(self.words) + len(first)

    def name(self, feature: int) -> str:
        if feature < len(self.words):
            return self.words[feature]
        word, k = self.first[feature - len(self.words)]
        return self.words[word][:k] + "*"

    def words_at(self, text: int) -> list[str]:
        return [self.words[i] for i in self.texts[text]]

    def features_at(self, text: int) -> np.ndarray:
        """The features of a text, each once, ascending."""
        found = np.unique(self.own[np.unique(self.texts[text])])
        return found[np.searchsorted(found, 0) :]


class _Known(dict):
    """A value for each word, made when first asked for; bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) > 200_000:
            self.clear()
        found = self.make(word)
        if len(word) <= 64:
            self[word] = found
        return found


class Votes:
    """The votes of texts as bits, in the order of ``VOTERS``."""

    def __init__(self, drawn: list[list[str]]):
        lists = [*_LISTS.values(), *drawn]
        self.insults = sum(1 << k for k in range(len(lists)) if k != list(LEXICONS).index("hate"))
        bits: dict[str, int] = {}
        for k, own in enumerate(lists):
            for feature in own:
                bits[feature] = bits.get(feature, 0) | 1 << k

        def own_bits(word: str) -> int:
            found = 0
            for feature in features_of(word):
                found |= bits.get(feature, 0)
            return found

        self.known = _Known(own_bits)

    def __call__(self, text: str | None) -> int:
        return self.of(words_of(text))

    def of(self, words: list[str]) -> int:
        found = [self.known[w] for w in words]
        mask = 0
        for bits in set(found):
            mask |= bits
        if mask:
            hits = [k for k, bits in enumerate(found) if bits & self.insults]
            addressed = any(not ADDRESS.isdisjoint(words[max(0, k - 3) : k]) for k in hits)
            several, dense = len({words[k] for k in hits}) > 1, any(b - a < 60 for a, b in zip(hits, hits[1:]))
            for k, vote in enumerate((addressed, several, dense), len(LEXICONS) + DRAWN_LISTS):
                mask |= vote << k
        return mask


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, sampled: int) -> Iterator[tuple[str, int | None]]:
    """At most ``rows`` labelled texts of each class outside the held-out fifth, and ``sampled`` other ones with None.

    Texts are chosen by their hash, each once. Only ids and hashes are joined and shuffled; the texts of the chosen ids,
    none longer than ``FITTED_CHARS``, are then fetched by a broadcast of so many ids at most.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", text.alias("text"))
    hashed = own.where(F.length("text") <= FITTED_CHARS).select("doc_id", F.xxhash64("text").alias("h"))
    once = hashed.join(known, "doc_id").groupBy("h").agg(F.min(F.struct("doc_id", "y")).alias("r")).select("h", "r.*")
    others = hashed.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("h", "doc_id", F.lit(None).cast("int").alias("y"))
    picked = (part.orderBy("h").limit(n) for part, n in ((once.where("y = 1"), rows), (once.where("y = 0"), rows), (others, sampled)))
    ids = reduce(DataFrame.unionByName, picked)
    ids = ids.groupBy("h").agg(F.min(F.struct(F.col("y").isNull().alias("free"), "doc_id", "y")).alias("r")).select("h", "r.doc_id", "r.y")
    found = own.join(F.broadcast(ids), "doc_id").where(F.xxhash64("text") == F.col("h")).dropDuplicates(["doc_id", "h"])
    return ((r["text"], r["y"]) for r in found.select("text", "y", "h").orderBy("h").toLocalIterator())


def _counts(texts: _Corpus, rows: Iterable[int], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features that at least three of the rows have, and the clean and the toxic texts that have each."""
    clean, toxic = np.zeros(texts.size), np.zeros(texts.size)
    for row, t in zip(rows, y.tolist(), strict=True):
        own = texts.features_at(row)
        clean[own] += 1 - t
        toxic[own] += t
    kept = np.flatnonzero(clean + toxic >= 3)
    return kept, clean[kept], toxic[kept]


def draw_lists(texts: _Corpus, rows: list[int], y: np.ndarray) -> list[list[str]]:
    """Words and beginnings that mark the toxic class in training rows, dealt into lists by rank."""
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    worth, times = {}, {}
    for number, clean, toxic in zip(*_counts(texts, rows, y), strict=True):
        p1, p0 = (toxic + 0.5) / (n1 + 1), (clean + 0.5) / (n0 + 1)
        if toxic >= 5 and p1 > 20 * p0:
            feature = texts.name(number)
            worth[feature], times[feature] = toxic * np.log(p1 / p0), toxic
    best = sorted(worth, key=lambda f: (-worth[f], f))[: DRAWN_LISTS * DRAWN_WORDS]
    # Only those nearly as frequent as the best: words of a few copied texts are left to no list.
    best = [f for f in best if times[f] >= 0.05 * times[best[0]]]
    return [best[k::DRAWN_LISTS] for k in range(DRAWN_LISTS)]


class LabelModel:
    """P(toxic | votes) from the counts of vote patterns; some patterns carry known labels.

    Within a class a voter's rate depends on the vote of its parent in a tree over the voters, the same for both.
    """

    def __init__(self, masks: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 60):
        """``known``: rows of (clean, toxic) labelled counts for each pattern."""
        self.bits = ((masks[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
        free = np.maximum(counts - known.sum(1), 0)
        self.parent = np.full(len(VOTERS), -1)
        # A toxic text is taken to move few voters before anything is known.
        self._learn([known[:, y] + (masks == 0) * 0.5 for y in (0, 1)])
        for step in range(rounds):
            p = self.posterior(self.bits)
            mass = [known[:, 0] + free * (1 - p), known[:, 1] + free * p]
            if step % 15 == 5:
                self.parent = self._tree(mass)
            before = self.rate
            self._learn(mass)
            if step > 20 and np.abs(self.rate - before).max() < 1e-7:
                break

    def _learn(self, mass: list[np.ndarray]) -> None:
        """``rate[y, a, k]``: how often voter k votes in class y when its parent's vote is a."""
        self.rate = np.empty((2, 2, len(VOTERS)))
        total = np.array([m.sum() for m in mass]) + 1.0
        self.prior = float(np.clip(total[1] / total.sum(), 1e-4, 1 - 1e-4))
        for y, m in enumerate(mass):
            alone = (m @ self.bits + 0.05) / (m.sum() + 0.1)
            both = (self.bits * m[:, None]).T @ self.bits
            for k, parent in enumerate(self.parent):
                if parent < 0:
                    self.rate[y, :, k] = alone[k]
                    continue
                voted = both[parent, parent], both[parent, k]
                not_voted = m.sum() - voted[0], both[k, k] - voted[1]
                for a, (n, hits) in enumerate((not_voted, voted)):
                    self.rate[y, a, k] = (max(hits, 0) + 2 * alone[k]) / (max(n, 0) + 2)
        self.rate = np.clip(self.rate, 1e-6, 1 - 1e-6)

    def _tree(self, mass: list[np.ndarray]) -> np.ndarray:
        """The parent of each voter (-1 for the first) in the spanning tree of the largest mutual information."""
        shared = np.zeros((len(VOTERS), len(VOTERS)))
        for m in mass:
            n = max(m.sum(), 1e-9)
            ones = (self.bits * m[:, None]).T @ self.bits / n
            alone = np.clip(np.diag(ones), 1e-9, 1 - 1e-9)
            for a in (0, 1):
                for b in (0, 1):
                    one, other = (np.abs(alone - 1 + bit) for bit in (a, b))  # P(vote is a), P(vote is b)
                    joint = ones if a and b else alone[:, None] - ones if a else alone[None, :] - ones if b else 1 - alone[:, None] - alone[None, :] + ones
                    joint = np.clip(joint, 1e-12, 1)
                    shared += n * joint * np.log(joint / np.outer(one, other))
        parent, reached = np.full(len(VOTERS), -1), [0]
        while len(reached) < len(VOTERS):
            rest = [k for k in range(len(VOTERS)) if k not in reached]
            link = shared[np.ix_(reached, rest)]
            a, b = np.unravel_index(link.argmax(), link.shape)
            parent[rest[b]] = reached[a]
            reached.append(rest[b])
        return parent

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        voted = np.where(self.parent >= 0, bits[:, self.parent], 0).astype(int)
        rate = self.rate[:, voted, np.arange(len(VOTERS))]
        clean, toxic = (np.log(np.where(bits > 0, r, 1 - r)).sum(axis=1) for r in rate)
        odds = toxic - clean + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_linear(texts: _Corpus, y: np.ndarray, trust: np.ndarray | None = None, features: int = FEATURES, rounds: int = 300, l1: float = 3e-4) -> tuple[float, dict[str, float]]:
    """Logistic regression with an L1 penalty on the presence of words and beginnings (proximal gradient with
    momentum); labels may be soft."""
    n1, n0 = max(y.sum(), 1e-9), max((1 - y).sum(), 1e-9)

    found, clean, toxic = _counts(texts, range(len(y)), y)
    share = np.clip((clean + toxic) / (n0 + n1), 1e-6, 1 - 1e-6)
    worth = np.abs(toxic / n1 - clean / n0) / np.sqrt(share * (1 - share))
    if len(found) > features:  # ties at the end of the list go by name
        last = np.partition(worth, -features)[-features]
        found, worth = found[worth >= last], worth[worth >= last]
    named = sorted((-w, texts.name(f), f) for w, f in zip(worth.tolist(), found.tolist(), strict=True))[:features]
    names = [name for _, name, _ in named]
    place = np.full(texts.size, -1, np.int32)
    place[[f for _, _, f in named]] = np.arange(len(names))
    cells = [np.sort(at[at >= 0]) for at in (place[texts.features_at(k)] for k in range(len(y)))]
    row = np.repeat(np.arange(len(y)), [len(c) for c in cells])
    column = np.concatenate([*cells, np.zeros(0, np.int32)]).astype(int)
    del cells, place, found, clean, toxic, share, worth, named
    # Both classes weigh the same in the fit.
    trust = np.ones(len(y)) if trust is None else trust
    mass = [max(trust[(y >= 0.5) == toxic].sum(), 1e-9) for toxic in (False, True)]
    weight = 0.5 * trust / np.where(y >= 0.5, mass[1], mass[0])

    def forward(w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(row, w[column], len(y)) + b

    # The step is one over the slope's own bound, a quarter of the largest eigenvalue of the weighted cells.
    v, size = np.ones(len(names) + 1), 1.0
    for _ in range(30):
        z = weight * forward(v[:-1], v[-1])
        v = np.append(np.bincount(column, z[row], len(names)), z.sum())
        size = max(float(np.sqrt(v @ v)), 1e-9)
        v /= size
    step = 4.0 / (1.1 * size)
    w, b, momentum, ahead, b_ahead = np.zeros(len(names)), 0.0, 1.0, np.zeros(len(names)), 0.0
    for _ in range(rounds):
        z = forward(ahead, b_ahead)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        new = ahead - step * np.bincount(column, error[row], len(names))
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = b_ahead - step * error.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, b_ahead = new + (momentum - 1) / after * (new - w), new_b + (momentum - 1) / after * (new_b - b)
        w, b, momentum = new, new_b, after
    return b, {name: float(v) for name, v in zip(names, w, strict=True) if v}


def _vote_counts(docs: DataFrame, drawn: list[list[str]]) -> dict[int, int]:
    """How many texts have each vote pattern: 2**16 rows at the most."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(drawn)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(t) for t in batch.column(0).to_pylist()], pa.int64())], names=["mask"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "mask long").groupBy("mask").count()
    return {r["mask"]: r["count"] for r in counted.collect()}


def fit(docs: DataFrame, labels: DataFrame) -> tuple[float, dict[str, float]]:
    """Intercept and weights; with no labelled rows the written lists alone vote."""
    examples = training_rows(docs, labels, "toxic", LABELLED_ROWS, SAMPLED_ROWS)
    return fit_posteriors(examples, lambda drawn: _vote_counts(docs, drawn))


def fit_posteriors(examples: Iterable[tuple[str, int | None]], vote_counts: Callable[[list[list[str]]], dict[int, int]]) -> tuple[float, dict[str, float]]:
    """Intercept and weights from texts, the labels of some (None: no label) and the corpus's counts of vote patterns
    (by drawn lists). Texts may come one by one; none is kept."""
    labels: list[int | None] = []

    def words() -> Iterator[list[str]]:
        for text, label in examples:
            labels.append(label)
            yield words_of(text)
        if all(label is None for label in labels):
            # The written words stand for toxic texts, an empty text for a clean one, beside the sample.
            yield from ([w] for w in sorted(frozenset().union(*_LISTS.values())) for _ in range(3))
            yield from ([] for _ in range(3))

    texts = _Corpus(words())
    labelled = [k for k, y in enumerate(labels) if y is not None]
    y = np.array([labels[k] for k in labelled], float)
    drawn = draw_lists(texts, labelled, y)
    votes = Votes(drawn)
    seen = [votes.of(texts.words_at(k)) for k in range(len(labels))]
    del votes
    counts = vote_counts(drawn)
    masks = np.array(sorted({*counts, *seen, 0}), np.int64)
    known = Counter((seen[k], labels[k]) for k in labelled)
    table = np.array([[known[m, 0], known[m, 1]] for m in masks.tolist()], float)
    if not known:  # two votes or more are taken for toxic as a start
        own = np.array([m.bit_count() for m in masks.tolist()])
        table = np.stack([own == 0, own > 1], 1) * 10.0
    model = LabelModel(masks, np.array([counts.get(m, 0) for m in masks.tolist()], float), table)
    voted = dict(zip(masks.tolist(), np.clip(model.posterior(model.bits), 1e-9, 1 - 1e-9), strict=True))
    odds = np.array([np.log(voted[m] / (1 - voted[m])) for m in seen])
    odds[labelled] += np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)) * (2 * y - 1)
    odds = np.append(odds, [30.0 if len(words) else -30.0 for words in texts.texts[len(odds) :]])
    p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    trust = SAMPLE_TRUST * np.abs(2 * p - 1)
    trust[labelled] = 1.0
    return fit_linear(texts, p, trust)


def score(docs: DataFrame, intercept: float, weights: dict[str, float], name: str = "score") -> DataFrame:
    """``docs`` with a column of the classifier's probability for every whole text; null and empty texts get the
    intercept's. The name must not be that of a column there is."""
    python_tasks(docs.sparkSession)
    # Tasks get plain names: any sign may stand in the real ones.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    out = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(lambda w: tuple(f for f in features_of(w) if f in weights))
        for batch in batches:
            scores = []
            for text in batch.column(at).to_pylist():
                found = {f for w in set(words_of(text)) for f in known[w]}
                z = intercept + sum(weights[f] for f in sorted(found))
                scores.append(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return plain.mapInArrow(run, out).toDF(*docs.columns, name)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row.

    Labels are learned from rows whose crc32(doc_id) mod 5 is not 0, at most ``LABELLED_ROWS`` distinct texts of each
    class; posteriors of at most ``SAMPLED_ROWS`` further texts of those rows train the classifier with them.
    A null doc_id is never trained on and counts as not held out. Repeated rows get equal scores; empty in, empty out.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    intercept, weights = fit(own, labels)
    scored = score(own, intercept, weights)
    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, whatever their names."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    intercept, weights = fit(own, labels)
    (name,) = own_names(docs, "toxic_score")
    return score(docs, intercept, weights, name).where(F.col(name) < threshold).select(*map(quoted, docs.columns))
