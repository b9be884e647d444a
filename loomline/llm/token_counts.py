"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is, summed over its pre-tokens, the number of start symbols minus the number of
merges; identifiers are never put out.  Pre-tokens repeat, so each Python process keeps the counts
of those it has met in a bounded table.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm import merges
from loomline.llm.common import per_batch, spread

REMEMBERED = 500_000
LONGEST_REMEMBERED = 40


class _Counts(dict):
    """Tokens of a pre-token; bounded in entries, and long pre-tokens are not kept."""

    def __init__(self, table: merges.MergeTable):
        super().__init__()
        self.table = table

    def __missing__(self, piece):
        word = piece if isinstance(piece, bytes) else piece.encode("utf-8")
        n = len(word) - self.table.merge(self.table.start(word))
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


@functools.lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(merges.load(path))


def count_text(path: str, text: str) -> int:
    """Tokens of one whole text; special strings inside it count as one token each."""
    counts, total = _counts(path), 0
    for part, special in counts.table.sections(text):
        pieces = merges.split_far(path, part) if merges.FAR.search(part) else merges.BYTE_LEVEL.findall(part)
        total += sum(map(counts.__getitem__, pieces)) + (special >= 0)
    return total


def count_tokens(documents: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every text; one map over the rows, no shuffle.

    Returns ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit), a
    row for each input row.  A null or empty text has 0 bytes and 0 tokens; rows that repeat, null
    ids included, are each counted; an empty table gives an empty result; a text of any length is
    taken whole.  ``path`` names a byte-level tokenizer file present on every executor.
    """
    id_type = documents.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
        sizes = [len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts]
        tokens = [count_text(path, t) for t in texts]
        over = [n > limit for n in tokens]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(over, pa.bool_())],
            names=[id_col, "n_bytes", "n_tokens", "over_limit"],
        )

    return per_batch(spread(documents.select(id_col, text_col)), make, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
