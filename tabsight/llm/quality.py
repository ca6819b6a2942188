"""Quality scores: random-indexing word vectors pooled per text, a two-layer network, calibrated probabilities.

Every token gives two words: its letters in lower case, and its shape (case, digits, signs, and whether it repeats the
token before). Every word has an index vector of its own: a few +1 and -1 at places that its hash names. The word vector
of a word is the sum of the index vectors of the words around it, over all texts of the corpus; the ``LETTER_WORDS`` and
``SHAPE_WORDS`` most frequent words have one, rarer words count by their index vectors, as neighbours and in texts. A
text is the mean of its normalized word vectors and of its index vectors, of both kinds, and the spread of its shapes. A
network with one hidden layer (numpy) is trained on labelled rows; a temperature fitted on rows it has not seen makes
its probabilities honest.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import keep, python_tasks
from tabsight.llm.toxicity import held_out

LETTER_WORDS, SHAPE_WORDS, DIMENSIONS, ENTRIES, REACH = 12_288, 4_096, 64, 4, 2
#: Longer tokens are words like others, but the table of frequent words does not name them.
LONGEST_WORD = 64
#: Bits of a word's hash: the places and the signs of its index vector.
HASH_BITS = 7 * ENTRIES
HASH_MASK = (1 << HASH_BITS) - 1
#: Different (kind, word) that a counting task holds, and tokens that a worker knows, before they start anew.
HELD_WORDS, HELD_TOKENS = 400_000, 700_000
#: Characters of texts, and tokens, whose arrays are made at once.
RUN_CHARS, RUN_TOKENS = 1 << 20, 1 << 17
#: Parts of the table of word vectors that are summed apart, and rows that meet in one sum.
SLICES, MET_ROWS = 16, 64
#: Labelled rows that train the network, at most; every fifth of them only sets the temperature.
TRAIN_ROWS = 20_000
HIDDEN, ROUNDS, BATCH, RATE, DECAY = 32, 60, 256, 3e-3, 1e-4

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_REPEATS = re.compile(r"(.)\1+")
_PLAIN = re.compile(r"([^\W\d_]+)([^\w\s]?)")
#: Signs that often follow a word.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"


def _kind(run: str) -> str:
    return "a" if run.islower() else "A" if run.isupper() and len(run) > 1 else "B" if run[1:].islower() or len(run) == 1 else "M"


def words_of_token(token: str) -> tuple[str, str]:
    """The letters of a token in lower case, and its shape: case, digits and signs, with runs cut to two."""
    if token.isalpha() and len(token) < LONGEST_WORD:
        return token.lower(), "a" if token.islower() else _kind(token)
    letters = token.rstrip(_SIGNS)
    # This capital alone is lowered to two signs, the second of them no letter.
    if letters.isalpha() and "\u0130" not in letters:
        signs = token[len(letters) :]
        return letters.lower(), _kind(letters) + (signs if len(signs) < 3 else _REPEATS.sub(r"\1\1", signs))
    plain = _PLAIN.fullmatch(token)
    if plain:
        return plain[1].lower(), _kind(plain[1]) + plain[2]
    shape = _DIGITS.sub("9", _LETTERS.sub(lambda m: _kind(m[0]), token))
    return "".join(_LETTERS.findall(token.lower())), _REPEATS.sub(r"\1\1", shape)


def _hash(word: str) -> int:
    """``HASH_BITS`` bits that name the places and signs of a word's index vector."""
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & HASH_MASK


def index_entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, ``ENTRIES``) places and signs of the index vectors of hashed words."""
    shifts = np.arange(ENTRIES)
    hashes = hashes.astype(np.int32)[:, None]
    signs = 1.0 - 2.0 * ((hashes >> (6 * ENTRIES + shifts).astype(np.int32)) & 1)
    return ((hashes >> (6 * shifts).astype(np.int32)) & (DIMENSIONS - 1)).astype(np.int64), signs


class Tokens(dict):
    """Tokens to numbers of ``rows``, each the word of the token's letters and the number of its shape; ``shape_words`` holds two words
    a shape, of it and of its repetition.

    A word is one whole number: its number among the frequent words and 1 (0 for rarer ones), then its hash.
    """

    def __init__(self, words: tuple[list[str], list[str]]):
        super().__init__()
        self.known = [{w: k + 1 for k, w in enumerate(own)} for own in words]
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.shapes: dict[str, int] = {}
        self.rows, self.shape_words = array("q"), array("q")

    def word(self, kind: int, word: str) -> int:
        """A frequent word or any other as a whole number."""
        return self.known[kind].get(word, 0) << HASH_BITS | _hash(word)

    def __missing__(self, token: str) -> int:
        letters, shape = words_of_token(token)
        number = self.shapes.get(shape)
        if number is None:
            number = self.shapes[shape] = len(self.shapes)
            self.shape_words.extend((self.word(1, shape), self.word(1, f"{shape} again")))
        self.rows.append(self.word(0, letters))
        self.rows.append(number)
        self[token] = row = len(self)
        return row

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The text, and the words of letters and shape, of every token of some texts."""
        split = [text.split() if text else [] for text in texts]
        lengths = [len(own) for own in split]
        if len(self) > HELD_TOKENS:
            self._forget()
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, sum(lengths))
        owner = np.repeat(np.arange(len(texts)), lengths)
        if not len(at):
            return owner, [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        # The views must be gone before the rows grow again.
        found = np.frombuffer(self.rows, np.int64).reshape(-1, 2)[at]
        again = np.zeros(len(at), bool)
        again[1:] = (at[1:] == at[:-1]) & (owner[1:] == owner[:-1])
        return owner, [found[:, 0].copy(), np.frombuffer(self.shape_words, np.int64)[2 * found[:, 1] + again]]


_HELD: dict[int, Tokens] = {}


def tokens_of(words: tuple[list[str], list[str]]) -> Tokens:
    """What a worker knows of the tokens serves its later tasks, as long as the frequent words are the same."""
    key = zlib.crc32("\n".join("\t".join(own) for own in words).encode("utf-8", "surrogatepass"))
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Tokens(words)
    return _HELD[key]


def _some_texts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """A batch in runs of about ``RUN_CHARS`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text or "") > RUN_CHARS:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text or "")
    if run:
        yield run


def frequent_words(docs: DataFrame) -> tuple[list[str], list[str]]:
    """The most frequent letter words and shapes of all texts; ties by the word. So many words reach the driver."""
    python_tasks(docs.sparkSession)

    def rows_of(tokens: Counter) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for token, n in tokens.items():
            letters, shape = words_of_token(token)
            held[0][letters] += n
            held[1][shape] += n
        for kind, own in enumerate(held):
            names = pa.array(list(own), pa.string())
            rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), names, pa.array(list(own.values()), pa.int64())], names=["kind", "word", "n"])
            length = pc.utf8_length(names)
            yield rows.filter(pc.and_(pc.greater(length, 0), pc.less_equal(length, LONGEST_WORD)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    tokens.update(text.split())
            if len(tokens) >= HELD_WORDS:
                yield from rows_of(tokens)
                tokens.clear()
        yield from rows_of(tokens)

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, word string, n long")
    counted = keep(counted.groupBy("kind", "word").agg(F.sum("n").alias("n")), "words")
    best = [counted.where(F.col("kind") == kind).orderBy(F.desc("n"), "word").limit(n) for kind, n in ((0, LETTER_WORDS), (1, SHAPE_WORDS // 2))]
    letters, shapes = ([r["word"] for r in own.select("word").collect()] for own in best)
    return letters, [*shapes, *(f"{s} again" for s in shapes)]


def add_contexts(total: np.ndarray, owner: np.ndarray, read: list[np.ndarray], own: tuple[int, int], first: int, letters: int) -> None:
    """Add the index vectors of the neighbours of the tokens ``own`` (places counted from ``first``) to their words.

    Equal pairs of a word and a neighbour are counted first and added once, times their number.
    """
    places = np.arange(first, first + len(owner))
    here = (places >= own[0]) & (places < own[1])
    gaps = [(gap, owner[:-gap] == owner[gap:]) for gap in range(1, min(REACH, len(owner) - 1) + 1)]
    for kind, offset in ((0, 0), (1, letters)):
        words = read[kind]
        centres, near = words >> HASH_BITS << HASH_BITS, words & HASH_MASK
        counts = here & (centres > 0)
        pairs = [np.zeros(0, np.int64)]
        for gap, same in gaps:
            for centre, other in ((slice(None, -gap), slice(gap, None)), (slice(gap, None), slice(None, -gap))):
                pairs.append((centres[centre] | near[other])[same & counts[centre]])
        found, times = np.unique(np.concatenate(pairs), return_counts=True)
        if len(found):
            entries, signs = index_entries(found & HASH_MASK)
            cells = (((found >> HASH_BITS) - 1 + offset) * DIMENSIONS)[:, None] + entries
            low = cells[0, 0] // DIMENSIONS * DIMENSIONS  # pairs are in the order of their centres
            added = np.bincount((cells - low).ravel(), (times[:, None] * signs).ravel())
            total[low : low + len(added)] += added


def word_vectors(docs: DataFrame, words: tuple[list[str], list[str]]) -> list[np.ndarray]:
    """The normalized vectors of the frequent letter words and shapes, from all texts.

    A task adds up its own texts into one table of fixed size (4 MB) and writes it in slices; slices are summed by tens,
    so that no sum meets more than ``MET_ROWS`` of them, and one table reaches the driver.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    sizes = [len(own) for own in words]
    cells = sum(sizes) * DIMENSIONS
    step = -(-cells // SLICES) or 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = tokens_of(words), np.zeros(cells)  # whole numbers, exact in doubles
        for batch in batches:
            for texts in _some_texts(batch.column(0).to_pylist()):
                owner, read = tokens.read(texts)
                for begin in range(0, len(owner), RUN_TOKENS):
                    here = slice(max(0, begin - REACH), begin + RUN_TOKENS + REACH)
                    add_contexts(total, owner[here], [own[here] for own in read], (begin, begin + RUN_TOKENS), here.start, sizes[0])
        slices = [total[k * step : (k + 1) * step].astype(np.int64).tobytes() for k in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(slices, pa.binary())], names=["slice", "part"])

    def add(_, rows):
        return rows.iloc[:1].assign(part=[np.sum([np.frombuffer(p, np.int64) for p in rows["part"]], axis=0).tobytes()])

    parts = keep(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(gather, "slice int, part binary"), "contexts")
    while (count := parts.count()) > SLICES:
        groups = max(1, -(-count // SLICES // MET_ROWS))
        grouped = parts.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        parts = keep(grouped.groupBy("slice", "group").applyInPandas(add, "slice int, part binary, group long").select("slice", "part"), "contexts")
    made = b"".join(r["part"] for r in parts.orderBy("slice").collect())
    table = np.frombuffer(made, np.int64).astype(float).reshape(-1, DIMENSIONS) if made else np.zeros((sum(sizes), DIMENSIONS))
    table = (table / np.maximum(np.sqrt((table * table).sum(1, keepdims=True)), 1e-12)).astype(np.float32)
    return [table[: sizes[0]], table[sizes[0] :]]


def pooled(texts: list[str | None], vectors: list[np.ndarray], tokens: Tokens) -> np.ndarray:
    """The vectors of some texts; zeros for a text without a token."""
    owner, read = tokens.read(texts)
    lengths = np.bincount(owner, minlength=len(texts))
    scale = 1 / np.maximum(lengths, 1)
    parts = []
    for kind in (0, 1):
        # Equal words of a text are one pair; a text's frequent words are in the order of their numbers, after the rarer ones.
        bits = HASH_BITS + len(vectors[kind]).bit_length()
        pairs, counts = np.unique(owner << bits | read[kind], return_counts=True)
        of_pair, word = pairs >> bits, (pairs >> HASH_BITS & (1 << bits - HASH_BITS) - 1) - 1
        known = word >= 0
        of_text = of_pair[known]
        share = (counts[known] * scale[of_text]).astype(np.float32)[:, None]
        sums = np.zeros((2, len(texts), DIMENSIONS), np.float32)
        if len(of_text):
            begins = np.flatnonzero(np.append(True, of_text[1:] != of_text[:-1]))
            own = vectors[kind][word[known]]
            sums[0, of_text[begins]] = np.add.reduceat(share * own, begins)
            if kind:
                sums[1, of_text[begins]] = np.add.reduceat(share * own * own, begins)
        index = np.zeros(len(texts) * DIMENSIONS)
        for begin in range(0, len(pairs), RUN_TOKENS):
            here = slice(begin, begin + RUN_TOKENS)
            entries, signs = index_entries(pairs[here] & HASH_MASK)
            index += np.bincount((of_pair[here, None] * DIMENSIONS + entries).ravel(), (counts[here, None] * signs).ravel(), len(index))
        parts += [sums[0], index.reshape(-1, DIMENSIONS) * scale[:, None]]
    # How far the shapes spread around their mean, and the length.
    seen = np.bincount(of_text, counts[known], len(texts))[:, None] * scale[:, None]
    spread = sums[1] - 2 * sums[0] ** 2 + sums[0] ** 2 * seen
    parts += [np.sqrt(np.maximum(spread, 0)), np.log1p(lengths)[:, None] / 10]
    return np.concatenate(parts, axis=1).astype(np.float32)


def _texts_to_vectors(docs: DataFrame, words: tuple[list[str], list[str]], vectors: list[np.ndarray], extra: list[str]) -> DataFrame:
    python_tasks(docs.sparkSession)
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra), "pooled array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(words)
        for batch in batches:
            rows = [row for texts in _some_texts(batch.column("text").to_pylist()) for row in pooled(texts, vectors, tokens)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], pa.array(rows, pa.list_(pa.float32()))], names=[*extra, "pooled"])

    return docs.select(*extra, "text").mapInArrow(run, schema)


class Network:
    """Two layers: tanh units, then one logistic output, divided by a temperature."""

    def __init__(self, inputs: np.ndarray, y: np.ndarray, seed: int = 3):
        self.mean, self.scale = inputs.mean(0), inputs.std(0) + 1e-3
        random = np.random.default_rng(seed)
        self.temperature = 1.0
        self.parts = [
            random.standard_normal((inputs.shape[1], HIDDEN)) / np.sqrt(inputs.shape[1]), np.zeros(HIDDEN),
            random.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1),
        ]
        check = np.arange(len(y)) % 5 == 4
        if not check.any() or check.all():
            check = np.zeros(len(y), bool)
        x = (inputs - self.mean) / self.scale
        self._train(x[~check], y[~check], random)
        if check.any():
            self._calibrate(self.logits(inputs[check]), y[check])

    def _train(self, x: np.ndarray, y: np.ndarray, random: np.random.Generator) -> None:
        first, second, step = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts], 0
        for _ in range(ROUNDS):
            order = random.permutation(len(y))
            for begin in range(0, len(y), BATCH):
                at = order[begin : begin + BATCH]
                hidden = np.tanh(x[at] @ self.parts[0] + self.parts[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ self.parts[2] + self.parts[3], -50, 50))) - y[at]) / len(at)
                back = error[:, None] * self.parts[2] * (1 - hidden * hidden)
                slopes = [x[at].T @ back + DECAY * self.parts[0], back.sum(0), hidden.T @ error + DECAY * self.parts[2], error.sum(keepdims=True)]
                step += 1
                for p, s, a, b in zip(self.parts, slopes, first, second, strict=True):
                    a += 0.1 * (s - a)
                    b += 0.001 * (s * s - b)
                    p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss among powers of 1.05 from about 0.1 to 10."""
        tries = 1.05 ** np.arange(-47, 48)
        self.temperature = float(min(tries, key=lambda t: np.mean(np.logaddexp(0, np.where(y > 0.5, -z, z) / t))))

    def logits(self, inputs: np.ndarray) -> np.ndarray:
        hidden = np.tanh((inputs - self.mean) / self.scale @ self.parts[0] + self.parts[1])
        return hidden @ self.parts[2] + self.parts[3]

    def probability(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(inputs) / self.temperature, -50, 50)))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row.

    Word vectors come from all texts; labels from rows whose crc32(doc_id) mod 5 is not 0, at most ``TRAIN_ROWS`` of
    them, chosen by the hash of their doc_id. Null and empty texts get the score of a text without words. A null doc_id is
    never trained on and counts as not held out. Without labels every score is 0.5. Empty in, empty out.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = frequent_words(own)
    vectors = word_vectors(own, words)
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    chosen = known.where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    train = _texts_to_vectors(own.join(F.broadcast(chosen), "doc_id"), words, vectors, ["doc_id", "y"])
    rows = train.orderBy(F.xxhash64("doc_id"), "doc_id").select("y", "pooled").toArrow()
    if rows.num_rows:
        inputs = rows.column("pooled").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        network = Network(inputs, rows.column("y").to_numpy().astype(float))
    else:
        network = None
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(words)
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if network and batch.num_rows:
                scores = np.concatenate([network.probability(pooled(texts, vectors, tokens)) for texts in _some_texts(batch.column("text").to_pylist())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = own.mapInArrow(run, "doc_id long, score double")
    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
