"""Byte-pair merge lists of public tokenizer files, and the heap that applies them.

A merge list is read from a ``tokenizers`` JSON file.  Symbols are vocabulary ids; a pair of ids
packs into one integer, and its entry packs the merge's rank above the id of the merged symbol, so
comparing entries compares ranks.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import regex

ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
#: Above every entry.
NONE = 1 << 3 * ID_BITS


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """What the operators need of one tokenizer file: start symbols, merges, pieces, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        end = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.pairs: list[tuple[str, str]] = pairs
        self.end = end
        self.first = [vocab[c] for c in alphabet]
        self.last = [vocab[c + end] for c in alphabet]
        self.entry: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            self.entry.setdefault(vocab[a] << ID_BITS | vocab[b], rank << ID_BITS | vocab[a + b])
        self.pieces: dict[int, str] = {i: piece for piece, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path} has added tokens with options that are not supported")
        self.pieces.update({i: s for s, i in self.special.items()})
        self.piece_bytes = {i: piece.encode("utf-8") for i, piece in self.pieces.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None

    def sections(self, text: str) -> Iterator[tuple[str, int]]:
        """The text cut at special strings: (ordinary text, id of the special string after it or -1)."""
        at = 0
        for m in self.special_pattern.finditer(text) if self.special_pattern else ():
            yield text[at : m.start()], self.special[m[0]]
            at = m.end()
        yield text[at:] if at else text, -1

    def start(self, word: bytes, ends: bool = True) -> list[int]:
        """The symbols of a word before any merge; its last byte carries the word end if ``ends``."""
        first = self.first
        symbols = [first[b] for b in word]
        if ends and word:
            symbols[-1] = self.last[word[-1]]
        return symbols

    def merge(self, symbols: list[int]) -> int:
        """Apply the merge list in place and return the number of merges done.

        Neighbours are a linked list over positions and adjacent pairs wait in a heap by rank, then
        position.  A merged-away position holds -1; a heap entry whose pair has changed is skipped.
        O(n log n) for n symbols, whatever they are.
        """
        get, n, merges = self.entry.get, len(symbols), 0
        shift = n.bit_length()
        here = (1 << shift) - 1
        heap, left = [], -1
        for i, s in enumerate(symbols, -1):
            e = get(left << ID_BITS | s)
            if e is not None:
                heap.append(e << shift | i)
            left = s
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & here
            j = after[i]
            if j == n or symbols[i] < 0 or get(symbols[i] << ID_BITS | symbols[j]) != top >> shift:
                continue
            symbols[i] = merged = top >> shift & ID_MASK
            symbols[j] = -1
            merges += 1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                e = get(merged << ID_BITS | symbols[j])
                if e is not None:
                    heappush(heap, e << shift | i)
            j = before[i]
            if j >= 0:
                e = get(symbols[j] << ID_BITS | merged)
                if e is not None:
                    heappush(heap, e << shift | j)
        return merges

    def merge_short(self, symbols: list[int]) -> list[int]:
        """The tokens of a short word: the same merges, found by scanning all pairs for the least."""
        get = self.entry.get
        entries = [get(a << ID_BITS | b, NONE) for a, b in zip(symbols, symbols[1:])]
        while entries and (least := min(entries)) != NONE:
            i = entries.index(least)
            symbols[i] = merged = least & ID_MASK
            del symbols[i + 1], entries[i]
            if i:
                entries[i - 1] = get(symbols[i - 1] << ID_BITS | merged, NONE)
            if i < len(entries):
                entries[i] = get(merged << ID_BITS | symbols[i + 1], NONE)
        return symbols


@functools.lru_cache(maxsize=4)
def load(path: str) -> MergeTable:
    """The merge table of a tokenizer file, read once in each Python process."""
    return MergeTable(path)


# The pre-tokenisation patterns of the two public vocabularies.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Beyond these characters the Unicode versions of two libraries may differ.
FAR = re.compile("[^\x00-ɏ]")


@functools.lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


def split_far(path: str, text: str) -> list[bytes]:
    """The words of a text with characters beyond ``FAR``, cut by the tokenizer file's own normalizer
    and pre-tokenizer, so that Unicode classes agree with the library's."""
    tokenizer, byte = library(path), _byte_of()
    if tokenizer.normalizer is not None:
        text = tokenizer.normalizer.normalize_str(text)
    return [bytes([byte[c] for c in piece]) for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
