"""Token ids of whole texts by a public tokenizer, with a bounded cache of words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabsight.llm.common import python_tasks

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Words of each of the two generations that a Python worker keeps.
CACHE_WORDS = 250_000

#: The tokenizer's own split of a text, for texts of Latin-1 characters in lower case.
_PARTS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r\x20\x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
)
_WIDE = re.compile("[^\x00-\xff]")
#: Where the library looks for its special tokens.
_SPECIAL = "<|"


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Words and their ids as bytes; the older of two generations goes when the newer one is full."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.encode(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class TokenEncoder:
    """Encodes texts as the tokenizers library does, word by word.

    The tokenizer splits every text into words, numbers and runs of signs and encodes each alone, so the library's
    vocabulary model is asked once for each distinct one. Texts beyond Latin-1 are split at spaces only, where the
    tokenizer never joins, and their pieces go through the library's whole chain.
    """

    def __init__(self, path: str = TOKENIZER):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path if "/" in path else public_tokenizers.path(path))
        self.code = "H" if self.whole.get_vocab_size() <= 65536 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.model = self.whole.model
        self.letters = str.maketrans(_byte_letters())
        self.parts = _Words(self._part, CACHE_WORDS)
        self.words = _Words(self._word, CACHE_WORDS)

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        return array(self.code, self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, little-endian, in the encoder's own width."""
        if not text:
            return b""
        if _WIDE.search(text) or _SPECIAL in text:
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))

    def ids(self, text: str | None, end_id: int | None = None) -> np.ndarray:
        got = np.frombuffer(self.encode(text), self.dtype)
        return got if end_id is None else np.append(got, self.dtype.type(end_id))


def encoded(docs: DataFrame, path: str = TOKENIZER, end_id: int | None = END_ID) -> DataFrame:
    """``doc_id``, ``ids`` (array of int): the ids of each whole text, a null text being empty."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenEncoder(path)
        for batch in batches:
            ids = [encoder.ids(t, end_id).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
