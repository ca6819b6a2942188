import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabsight.llm import packing, records
from tabsight.llm.tokens import END_ID, TOKENIZER, TokenEncoder

from .conftest import ODD

WHOLE = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
ENCODER = TokenEncoder()


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [END_ID]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aB'sS t!?.9é ß\x1c\x85\xa0<|>", max_size=40)))
def test_encoder_equals_the_library(text):
    assert ENCODER.ids(text, END_ID).tolist() == ids_of(text)


def test_special_token_strings():
    for text in ("<|endoftext|> a", "b<|startoftext|>", "<|other|>"):
        assert ENCODER.ids(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_record_files_round_trip(spark, odd, tmp_path):
    path, index = records.token_files(odd, str(tmp_path / "out"), files=4)
    rows = sorted(index.collect(), key=lambda r: r["start"])
    want = sorted(((i, ids_of(t)) for i, t in ODD), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(r["doc_id"], r["n_tokens"]) for r in rows] == [(i, len(x)) for i, x in want]
    start = 0
    for row, (_, ids) in zip(rows, want, strict=True):
        assert (row["start"], row["ids_crc32"]) == (start, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        data = open(row["file"].removeprefix("file:"), "rb").read()  # noqa: SIM115
        assert records.unframe(data, row["position"])[1].tolist() == ids
    read = records.read_ids(spark, path).collect()
    assert sorted(map(list, (r["ids"] for r in read))) == sorted(x for _, x in want)


def test_damage_is_found():
    good = records.frame(3, b"\1\0\2\0", False)
    assert records.unframe(good)[0] == 3
    for at in (0, 9, 13, len(good) - 3, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))


def test_no_records(none, tmp_path):
    _, index = records.token_files(none, str(tmp_path / "none"))
    assert index.count() == 0


def check_packed(rows, want, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    seen = sorted((key[0] or 0, start, length, crc) for key, own in by_doc.items() for start, length, crc in own)
    expected = sorted(
        (i or 0, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        for i, ids in want for at in range(0, len(ids), capacity) for part in [ids[at : at + capacity]]
    )
    assert seen == expected
    return len(by_sequence)


def test_packing_holds_every_id_once(odd):
    rows = packing.pack_documents(odd, capacity=64).collect()
    check_packed(rows, [(i, ids_of(t)) for i, t in ODD], 64)


def test_packing_nothing(none):
    assert packing.pack_documents(none).count() == 0


def test_packing_ids_column(documents):
    rows = packing.pack_documents(documents([(1, "some words to pack"), (2, None)]), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {1: ids_of("some words to pack"), 2: [END_ID]}


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=20))
def test_cutting_stock_covers_exactly(lengths):
    sizes = sorted(lengths)
    left = dict(lengths)
    found = packing.cutting_stock(sizes, [lengths[s] for s in sizes], 64)
    for times, pattern in found:
        assert times > 0 and sum(s * k for s, k in pattern.items()) <= 64
        for s, k in pattern.items():
            left[s] -= times * k
    assert not any(left.values())


def test_cutting_stock_beats_largest_first():
    """Thirds and halves that largest-first wastes: 2 x 20 + 24 and 3 x 21 fill 64 and 63."""
    sizes, counts = [20, 21, 24], [2000, 3000, 1000]
    used = sum(t for t, _ in packing.cutting_stock(sizes, counts, 64))
    assert used <= 2010
