"""Token counts and the BPE round trip against the tokenizers library."""

from __future__ import annotations

import hashlib
import struct
import tracemalloc
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomline.llm import bpe, merges, token_counts
from tests.llm.conftest import ODD

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


TEXT = st.text(st.one_of(st.sampled_from("aab '\n\tZé中İΣſ😀\x00\x85'stll019.-_<|>"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text(libraries, text):
    byte_level, word_level = libraries
    assert token_counts.count_text(BYTES, text) == len(byte_level.encode(text, add_special_tokens=False).ids)
    ids, decoded = expected(word_level, text)
    assert bpe.encode_text(WORDS, text) == (struct.pack(f"<{len(ids)}I", *ids), decoded)


def test_op1(odd, empty, documents, libraries):
    for frame in (odd, documents):
        expected = Counter()
        for doc_id, text in frame.select("doc_id", "text").collect():
            n = len(libraries[0].encode(text or "", add_special_tokens=False).ids)
            expected[doc_id, len((text or "").encode()), n, n > 512] += 1
        assert Counter(map(tuple, token_counts.count_tokens(frame, BYTES).collect())) == expected
    assert token_counts.count_tokens(empty, BYTES).collect() == []


def test_op9(odd, empty, libraries):
    key = lambda r: (r[0] is None, r[0])
    rows = sorted(bpe.encode_and_decode(odd, WORDS).collect(), key=key)
    assert len(rows) == len(ODD)
    for row, (doc_id, text, *_) in zip(rows, sorted(ODD, key=key)):
        ids, decoded = expected(libraries[1], text)
        assert row.doc_id == doc_id
        assert row.ids == ids and row.decoded == decoded and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_and_decode(empty, WORDS).collect() == []


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(0, 5))
def test_any_window(libraries, text, window):
    whole, size = expected(libraries[1], text), bpe.WINDOW
    try:
        bpe.WINDOW = window
        parts = [*bpe.stream(WORDS, text)]
    finally:
        bpe.WINDOW = size
    assert b"".join([p for p, _ in parts]) == struct.pack(f"<{len(whole[0])}I", *whole[0]) and " ".join([d for _, d in parts]) == whole[1]


def test_memory_does_not_grow_with_a_text():
    peaks = []
    for megabytes in (1, 8, 50):
        text = "several different words, 1234 of them. " * (megabytes * 1_000_000 // 39)
        if megabytes == 50:
            # Too slow to trace: what is put out at a time is bounded.
            assert max(len(packed) + len(back) for packed, back in bpe.stream(WORDS, text)) < 8 * bpe.WINDOW
            continue
        tracemalloc.start()
        for _ in bpe.stream(WORDS, text):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] + 1_000_000


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aeinorstlh"), min_size=1, max_size=300), st.integers(1, 40))
def test_streamed_tokens_are_those_of_the_whole_word(path, word, stride):
    table = merges.load(path)
    whole = table.start(word.encode())
    table.merge(whole)
    encoder = bpe.Encoder(table, bpe.lookahead(table) if path == BYTES else 866, stride)
    encoder.ahead = min(encoder.ahead, 400)
    pushed = [t for i in range(0, len(word), 13) for t in encoder.push(word[i : i + 13].encode())]
    assert pushed + encoder.close() == [s for s in whole if s >= 0]


def test_encoder_holds_a_bounded_window():
    table = merges.load(BYTES)
    encoder = bpe.Encoder(table, bpe.lookahead(table))
    for _ in range(200):
        list(encoder.push(b"tokenization" * 40))
        assert len(encoder.held) <= encoder.ahead + 2 * encoder.stride


def test_lookahead_of_small_lists():
    class Table:
        end = ""
        pairs = [("a", "b"), ("c", "ab"), ("d", "x")]

    # c may join ab, which may or may not have formed: two symbols.
    assert bpe.lookahead(Table) == 2


def test_short_and_heap_merging_agree():
    table = merges.load(WORDS)
    for word in (b"international", b"aaaaaaaaaaa", b"thethethe", b"z"):
        symbols = table.start(word)
        n = table.merge(symbols)
        short = table.merge_short(table.start(word))
        assert [s for s in symbols if s >= 0] == short and len(word) - n == len(short)


def test_decoder_holds_back_unfinished_characters():
    table = merges.load(WORDS)
    decoder = bpe.Decoder(table, between="")
    table_bytes = table.piece_bytes
    try:
        table.piece_bytes = {0: b"\xe4\xbd", 1: b"\xa0!"}
        assert decoder.push([0]) == "" and decoder.push([1]) == "你!" and decoder.close() == ""
    finally:
        table.piece_bytes = table_bytes
