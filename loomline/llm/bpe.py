"""BPE encoding and decoding as streaming transducers.

Encoding reads a word's symbols through a window.  How far the end of what has been read can still
change the tokens before it is a property of the merge list, its *sufficient lookahead*: suppose
two continuations agree on all tokens before position p after the merges up to some rank.  They can
only come to differ before p when a later merge (z, y) joins the token z that ends at p with a token
y that starts at p in one of them only; y then starts with the left part z' of the merge that moved
the agreed position to p.  So the distance is at most the longest chain of merges of rising rank in
which each right part starts with the left part before it, measured by the lengths of the left
parts.  ``lookahead`` computes that length in rank order.  Tokens that end at least so far before
the window's end are stable and are put out; the window keeps a bounded number of symbols, however
long the word is.

Decoding maps ids to byte pieces and feeds an incremental UTF-8 state machine, which holds back
the bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from sys import byteorder

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm import merges
from loomline.llm.common import per_batch, spread

REMEMBERED = 250_000
LONGEST_REMEMBERED = 40
#: Symbols read at a time beyond the lookahead.
STRIDE = 512
#: Characters of a text that are cut into words at a time.
WINDOW = 65_536
_BLANK = re.compile("[ \n]")
#: Symbols up to which scanning all pairs is cheaper than a heap.
SHORT = 24


def lookahead(table: merges.MergeTable) -> int:
    """Symbols after which no continuation can change a token: the longest chain described above."""
    end, far, longest = table.end, {}, 0
    for left, right in table.pairs:
        size = len(left) - (len(end) if end and left.endswith(end) else 0)
        # The left part of an earlier merge that the right part starts with.
        chain = size + max((far.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        if chain > far.get(left, 0):
            far[left] = chain
        longest = max(longest, chain)
    return longest


@functools.lru_cache(maxsize=4)
def _lookahead(path: str) -> int:
    return lookahead(merges.load(path))


class Encoder:
    """Push the bytes of one word, pull tokens once stable; ``close`` ends the word."""

    def __init__(self, table: merges.MergeTable, ahead: int, stride: int = STRIDE):
        self.table, self.ahead, self.stride, self.held = table, ahead, stride, b""

    def push(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.stride):
            self.held += data[at : at + self.stride]
            # One more byte than the lookahead, as the last may yet turn out to end the word.
            while len(self.held) > self.ahead + self.stride:
                before = len(self.held)
                yield from self._stable()
                if len(self.held) == before:
                    break  # a token longer than the stride: read on

    def _stable(self) -> Iterator[int]:
        symbols = self.table.start(self.held, ends=False)
        self.table.merge(symbols)
        safe, out, start = len(symbols) - self.ahead, [], 0
        for i, s in enumerate(symbols):
            if s >= 0:
                # A token ends where the next one starts.
                if i > safe:
                    break
                start = i
                out.append(s)
        self.held = self.held[start:]
        yield from out[:-1]

    def close(self) -> list[int]:
        symbols, self.held = self.table.start(self.held), b""
        if len(symbols) <= SHORT:
            return self.table.merge_short(symbols)
        self.table.merge(symbols)
        return [s for s in symbols if s >= 0]


class Decoder:
    """Push ids, pull text; pieces of a vocabulary without a decoder are joined by ``between``."""

    def __init__(self, table: merges.MergeTable, between: str = " "):
        self.table, self.between, self.begun = table, between.encode("utf-8"), False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        pieces = self.table.piece_bytes
        data = self.between.join([pieces[i] for i in ids])
        if data and self.begun:
            data = self.between + data
        self.begun = self.begun or bool(data)
        return self.machine.decode(data)

    def close(self) -> str:
        return self.machine.decode(b"", final=True)


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Words(dict):
    """(ids as little-endian 32-bit integers, decoded text) of a word; bounded in entries."""

    def __init__(self, path: str):
        super().__init__()
        self.table, self.ahead = merges.load(path), _lookahead(path)

    def __missing__(self, piece):
        word = piece if isinstance(piece, bytes) else piece.encode("utf-8")
        encoder, decoder = Encoder(self.table, self.ahead), Decoder(self.table)
        ids = [*encoder.push(word)] + encoder.close()
        both = (_packed(ids), decoder.push(ids) + decoder.close())
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = both
        return both


@functools.lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def _windows(text: str) -> Iterator[str]:
    """The text in order, in parts of about ``WINDOW`` characters that start at a blank or line end.

    No word holds a blank, and composing or lower-casing characters never looks across one.
    """
    start = 0
    while start < len(text):
        m = _BLANK.search(text, start + max(WINDOW, 1))
        stop = m.start() if m else len(text)
        yield text[start:stop]
        start = stop


def stream(path: str, text: str) -> Iterator[tuple[bytes, str]]:
    """(ids as little-endian unsigned 32-bit integers, decoded text) of each window with tokens, one after the other.

    What is held besides the text does not grow with it: a window's words, and a word's window in the ``Encoder``.
    """
    words = _words(path)
    for part, special in words.table.sections(text):
        for window in _windows(part):
            if merges.FAR.search(window):
                found = merges.split_far(path, window)
            else:  # composed already, and white space falls away between words
                found = merges.WORD_LEVEL.findall(window.lower())
            if found:
                out = [*map(words.__getitem__, found)]
                yield b"".join([ids for ids, _ in out]), " ".join([back for _, back in out])
        if special >= 0:
            yield _packed([special]), words.table.pieces[special]


def encode_text(path: str, text: str) -> tuple[bytes, str]:
    """(ids as little-endian unsigned 32-bit integers, decoded text) of one whole text."""
    out = [*stream(path, text)]
    return b"".join([ids for ids, _ in out]), " ".join([back for _, back in out])


def encode_and_decode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every text with a word-level BPE file and decode it again; one map, no shuffle.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and with ``keep_ids`` also
    ``ids`` (array of int) and ``decoded`` (text), a row for each input row.  A null or empty text
    has no tokens and decodes to the empty text; repeated rows and null ids are encoded alike; an
    empty table gives an empty result; texts and words of any length are taken whole, window by window,
    so that without ``keep_ids`` memory does not grow with a text beyond the text itself; columns other
    than the two named are not read.  ``path`` names a tokenizer file present on every executor.
    """
    def lists(packed: list[bytes]) -> pa.ListArray:
        offsets = np.cumsum([0, *(len(p) // 4 for p in packed)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))

    id_type = documents.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids_sha, text_sha, ids, decoded = [], [], [], [], []
        for text in batch.column(1):
            count, ids_hash, text_hash, kept = 0, hashlib.sha256(), hashlib.sha256(), []
            for packed, back in stream(path, text.as_py() or ""):
                ids_hash.update(packed)
                text_hash.update((" " + back if count else back).encode("utf-8"))
                count += len(packed) // 4
                if keep_ids:
                    kept.append((packed, back))
            n.append(count)
            ids_sha.append(ids_hash.hexdigest())
            text_sha.append(text_hash.hexdigest())
            if keep_ids:
                ids.append(b"".join([packed for packed, _ in kept]))
                decoded.append(" ".join([back for _, back in kept]))
        columns = {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
        if keep_ids:
            columns |= {"ids": lists(ids), "decoded": pa.array(decoded, pa.string())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    more = ", ids array<int>, decoded string" if keep_ids else ""
    return per_batch(spread(documents.select(id_col, text_col)), make, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
