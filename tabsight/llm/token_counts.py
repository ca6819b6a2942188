"""Token counts of whole texts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic machines are chained.

``SplitMachine`` reads characters and marks where the tokenizer's own split of a text into pieces begins a new piece. It
has a dozen states, so a chunk of text is a map from every entry state to an exit state. The maps of all chunks are
computed side by side, composed by a parallel prefix scan, and a second sweep, now with each chunk's true entry state,
writes the marks.

``CountMachine`` reads the bytes of a piece. A transition carries the change in the number of tokens of what has been
read. Its states are what the rest of the piece can still depend on: the suffixes read that tokens may grow from, each
with the last token before it. A token may follow another one if the vocabulary's own merges give just these two for
their joined bytes; exactly one token ends every prefix by that rule, which makes the machine deterministic. States and
transitions are compiled when a text first needs them, into a bounded table that all pieces of a batch walk side by side.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabsight.llm.common import python_tasks

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Characters that are read at once, and of one chunk of them.
BLOCK_CHARS, CHUNK_CHARS = 1 << 20, 128
#: Transitions after which the counting machine starts anew.
MOST_TRANSITIONS = 1 << 20
#: Bytes of a piece that are read side by side with other pieces; the rest of a longer one is read alone.
SIDE_BY_SIDE = 48

#: The endings that the tokenizer's split keeps as pieces of their own.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Stands between texts in a block; no character has this number.
END = 0x110000

_KINDS = ("end", "space", "blank", "letter", "number", "sign", "'", "s", "t", "r", "e", "v", "m", "l", "d")
_LETTERS = frozenset("strevmld")


@lru_cache(maxsize=1)
def character_kinds() -> np.ndarray:
    """Kind of every character: letters and numbers by Unicode category, blanks by the White_Space property."""
    kinds = np.full(END + 1, _KINDS.index("sign"), np.uint8)
    for code in range(END):
        category = unicodedata.category(chr(code))[0]
        if category == "L":
            kinds[code] = _KINDS.index("letter")
        elif category == "N":
            kinds[code] = _KINDS.index("number")
    # The characters of the White_Space property.
    blanks = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds[blanks] = _KINDS.index("blank")
    kinds[0x20] = _KINDS.index("space")
    for own in ("'", *_LETTERS):
        kinds[ord(own)] = _KINDS.index(own)
    kinds[END] = _KINDS.index("end")
    return kinds


class SplitMachine:
    """States are what the split needs to know of the characters before; symbols are a character's kind and its next's.

    A state is ``start`` or ``after`` a kind, or the unfinished or finished ending (such as "'r" or "'re") that was read.
    """

    def __init__(self):
        partial = sorted({e[:k] for e in ENDINGS for k in range(1, len(e))})
        self.states = ["start", "space", "blank", "letter", "number", "sign", *partial, "done"]
        wide = len(_KINDS)
        self.next = np.zeros((len(self.states), wide * wide), np.uint8)
        self.marks = np.zeros((len(self.states), wide * wide), bool)
        for a, state in enumerate(self.states):
            for b, kind in enumerate(_KINDS):
                for c, then in enumerate(_KINDS):
                    mark, after = self._step(state, kind, then)
                    self.next[a, b * wide + c], self.marks[a, b * wide + c] = self.states.index(after), mark

    @staticmethod
    def _step(state: str, kind: str, then: str) -> tuple[bool, str]:
        """Whether a piece begins with a character of this kind, and the state after it."""
        if kind == "end":
            return True, "start"
        group = "letter" if kind in _LETTERS else kind
        if group in ("space", "blank"):
            # Of several blanks before a text the last one is apart from the others.
            within = state in ("space", "blank") and then in ("end", "space", "blank")
            return not within, group
        if state.startswith("'"):
            grown = state + kind
            if grown in ENDINGS:
                return False, "done"
            if any(e.startswith(grown) and e == grown + then for e in ENDINGS):
                return False, grown
        joined = state == "space" or state == group or (state.startswith("'") or state == "sign") and group in ("sign", "'")
        if kind == "'":
            # An ending begins only where a piece does.
            return not joined, "sign" if joined else "'"
        return not joined, group

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        kinds = character_kinds()[codes]
        return kinds * np.uint8(len(_KINDS)) + np.append(kinds[1:], np.uint8(0))

    def chunk_maps(self, symbols: np.ndarray) -> np.ndarray:
        """(chunks, places) symbols to (chunks, states): the exit state for every entry state."""
        maps = np.broadcast_to(np.arange(len(self.states), dtype=np.uint8), (len(symbols), len(self.states)))
        for place in symbols.T:
            maps = self.next[maps, place[:, None]]
        return maps

    @staticmethod
    def prefix_scan(maps: np.ndarray) -> np.ndarray:
        """Row k becomes the composition of maps 0 to k, in as many steps as the number of chunks has bits."""
        step = 1
        while step < len(maps):
            maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)])
            step *= 2
        return maps

    def begins(self, codes: np.ndarray, chunk: int = CHUNK_CHARS) -> np.ndarray:
        """For each character of texts laid end to end, each followed by ``END``: does a piece begin there?"""
        symbols = self.symbols(codes)
        padded = np.zeros(-(-len(symbols) // chunk) * chunk, np.uint8)
        padded[: len(symbols)] = symbols
        chunks = padded.reshape(-1, chunk)
        scanned = self.prefix_scan(self.chunk_maps(chunks))
        state = np.concatenate([np.zeros(1, np.uint8), scanned[:-1, 0]])
        marks = np.empty(chunks.shape, bool)
        for k, place in enumerate(chunks.T):
            marks[:, k] = self.marks[state, place]
            state = self.next[state, place]
        return marks.ravel()[: len(symbols)]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class CountMachine:
    """Walks the bytes of pieces and sums what the transitions say; compiled as it goes."""

    def __init__(self, model, vocabulary: dict[str, int], most: int = MOST_TRANSITIONS):
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.model, self.letters, self.most = model, letters, most
        self.tokens = {bytes(byte_of[c] for c in name) for name in vocabulary if all(c in byte_of for c in name)}
        self.growing = {token[:k] for token in self.tokens for k in range(1, len(token))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.state_of: dict[tuple, int] = {((b"", None, 0),): 0}
        self.kept = [((b"", None, 0),)]
        bits = (4 * self.most - 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.targets, self.changes = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.filled = 0

    def follows(self, before: bytes | None, token: bytes) -> bool:
        """Do the merges leave these two tokens as they are when their bytes are joined?"""
        key = (before or b"", token)
        known = self.pairs.get(key)
        if known is None:
            text = "".join(self.letters[b] for b in key[0] + token)
            want = ["".join(self.letters[b] for b in part) for part in key if part]
            known = [t.value for t in self.model.tokenize(text)] == want
            if len(self.pairs) >= self.most:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state by a byte: next state and change of the count.

        A state lists suffixes of what was read that may still begin a token, longest first: (suffix, the token before
        it, how many tokens fewer there are up to its begin). The empty suffix is always listed, last.
        """
        read, last, fewer_now = [], None, 0
        for suffix, before, fewer in self.kept[state]:
            grown = suffix + bytes((byte,))
            if last is None and grown in self.tokens and self.follows(before, grown):
                last, fewer_now = grown, fewer
            if grown in self.growing:
                read.append((grown, before, fewer))
        if last is None:
            raise ValueError("The vocabulary lacks a token for a byte, or its merges are no byte-pair encoding.")
        change = 1 - fewer_now
        key = (*((suffix, before, fewer + change) for suffix, before, fewer in read), (b"", last, 0))
        target = self.state_of.setdefault(key, len(self.kept))
        if target == len(self.kept):
            self.kept.append(key)
        return target, change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys in the open table: where they stand, or the empty place where they would."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.keys[at]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        return at

    def step(self, states: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of the count for many (state, byte) at once."""
        keys = (states.astype(np.int64) << 8) | read
        at = self._slots(keys)
        unknown = self.keys[at] != keys
        if unknown.any():
            for key in np.unique(keys[unknown]).tolist():
                target, change = self.compile(key >> 8, key & 255)
                own = self._slots(np.array([key]))[0]
                self.keys[own], self.targets[own], self.changes[own] = key, target, change
                self.filled += 1
            if self.filled > 2 * self.most:  # the table is four times ``most``: at most half full
                raise OverflowError
            at = self._slots(keys)
        return self.targets[at], self.changes[at]

    def counts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each piece ``data[begin:end]``."""
        if self.filled > self.most:
            self.clear()
        if len(begin) > 1:
            try:
                return self._walk(data, begin, end)
            except OverflowError:
                # Too many new transitions for one table: by halves.
                middle = len(begin) // 2
                self.clear()
                return np.concatenate([self.counts(data, begin[:middle], end[:middle]), self.counts(data, begin[middle:], end[middle:])])
        return np.array([self._alone(data[b:e], 0, 0) for b, e in zip(begin, end, strict=True)], np.int64)

    def _walk(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """All pieces side by side, longest first, so that those still read are a prefix of the arrays."""
        order = np.argsort(begin - end, kind="stable")
        begin, length = begin[order], (end - begin)[order]
        states, counts = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        reading = np.searchsorted(-length, -np.arange(min(int(length[0]), SIDE_BY_SIDE)), side="left")
        for place, n in enumerate(reading.tolist()):
            states[:n], change = self.step(states[:n], data[begin[:n] + place])
            counts[:n] += change
        for k in range(int(np.searchsorted(-length, -SIDE_BY_SIDE, side="left"))):
            rest = data[begin[k] + SIDE_BY_SIDE : begin[k] + length[k]]
            counts[k] = self._alone(rest, int(states[k]), int(counts[k]))
        out = np.empty(len(order), np.int64)
        out[order] = counts
        return out

    def _alone(self, read: np.ndarray, state: int, count: int) -> int:
        """One long piece; its states are kept by value, so that clearing the table cannot lose the place."""
        known: dict[int, tuple[int, int]] = {}
        for byte in read.tobytes():
            key = state << 8 | byte
            got = known.get(key)
            if got is None:
                if len(self.kept) > 2 * self.most:
                    here = self.kept[state]
                    self.clear()
                    known.clear()
                    state = self.state_of.setdefault(here, len(self.kept))
                    if state == len(self.kept):
                        self.kept.append(here)
                    key = state << 8 | byte
                got = known[key] = self.compile(state, byte)
            state, change = got
            count += change
        return count


class TokenCounter:
    """Counts the tokens of texts as the library gives them; special strings in a text are one token each."""

    def __init__(self, path: str = TOKENIZER, block: int = BLOCK_CHARS):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = path if "/" in path else public_tokenizers.path(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        split = made["pre_tokenizer"] or {}
        if made["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or made["normalizer"]:
            raise ValueError("Only byte-level BPE with the usual split and without a normalizer can be compiled.")
        self.special = [t["content"] for t in made["added_tokens"] if t["special"]]
        self.splits = SplitMachine()
        self.machine = CountMachine(Tokenizer.from_file(path).model, made["model"]["vocab"])
        self.block = block

    def _segments(self, text: str) -> list[str]:
        parts = [text]
        for special in self.special:
            parts = [own for part in parts for own in part.split(special)]
        return parts

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; texts are laid end to end into blocks, long ones are cut where a piece begins."""
        totals, waiting, size = [0] * len(texts), [], 0
        for k, text in enumerate(texts):
            parts = self._segments(text)
            totals[k] = len(parts) - 1
            for part in parts:
                if not part:
                    continue
                if size + len(part) > self.block:
                    self._read(waiting, totals)
                    waiting, size = [], 0
                waiting.append((k, part))
                size += len(part) + 1
        self._read(waiting, totals)
        return totals

    def _read(self, waiting: list[tuple[int, str]], totals: list[int]) -> None:
        if not waiting:
            return
        if len(waiting) == 1 and len(waiting[0][1]) > self.block:
            owner, text = waiting[0]
            while text:
                cut = self._cut(text)
                self._count([(owner, text[:cut])], totals)
                text = text[cut:]
            return
        self._count(waiting, totals)

    def _cut(self, text: str) -> int:
        """The last place within a block where a piece begins after a character that is no blank; else a later one."""
        size = self.block
        while size < len(text):
            codes = np.frombuffer(text[: size + 2].encode("utf-32-le"), np.uint32)
            begins = self.splits.begins(codes)[1:size]  # the character after each of these is known
            blank = np.isin(character_kinds()[codes[: size - 1]], [_KINDS.index("space"), _KINDS.index("blank")])
            # Blanks before a cut would be split as those at the end of a text are.
            found = np.flatnonzero(begins & ~blank) + 1
            if len(found):
                return int(found[-1])
            size *= 2
        return len(text)

    def _count(self, waiting: list[tuple[int, str]], totals: list[int]) -> None:
        owners = np.array([k for k, _ in waiting])
        lengths = np.array([len(part) for _, part in waiting])
        codes = np.frombuffer("\0".join(part for _, part in waiting).encode("utf-32-le") + b"\0" * 4, np.uint32).copy()
        codes[np.cumsum(lengths + 1) - 1] = END
        marks = self.splits.begins(codes)
        # Texts take one byte between them in ``data`` too, so places of characters and bytes run alike.
        data = np.frombuffer("\0".join(part for _, part in waiting).encode() + b"\0", np.uint8)
        wide = 1 + (codes > 0x7F) + (codes > 0x7FF) + ((codes > 0xFFFF) & (codes != END))
        wide[codes == END] = 1
        place = np.cumsum(wide) - wide
        at = np.flatnonzero(marks)
        begin, real = place[at], codes[at] != END
        end = np.append(begin[1:], len(data))
        owner = owners[np.searchsorted(np.cumsum(lengths + 1), at, side="right")]
        found = self.machine.counts(data, begin[real], end[real])
        sums = np.zeros(len(totals), np.int64)
        np.add.at(sums, owner[real], found)
        for k in np.unique(owners).tolist():
            totals[k] += int(sums[k])


@lru_cache(maxsize=2)
def counter(path: str = TOKENIZER) -> TokenCounter:
    """One counter a Python worker; what it has compiled serves later tasks."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every whole text.

    A null or empty text has no bytes and no tokens; rows are answered as often as they stand there, null ids included;
    very long texts are read in blocks. An empty table gives an empty one. Only ``doc_id`` and ``text`` are read, so
    further columns cannot clash.
    """
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = pa.array(counter(path).counts(texts), pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
