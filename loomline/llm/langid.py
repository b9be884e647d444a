"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (n = 1 to 3, words padded with a blank) of a
language in the order of their frequency over all its training texts.  A text is ranked likewise
and compared with each profile by out-of-place distance: the sum over its n-grams of how far their
ranks lie apart, or ``size`` for n-grams that the profile lacks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import cut, spread

#: N-grams in a profile.
SIZE = 300
#: Languages whose profiles form one table of ranks, and languages that a map is given at a time.
LANGUAGES, TOGETHER = 128, 2_000
#: Texts and characters that are worked on together.
TEXTS, CHARACTERS = 1024, 400_000
#: An n-gram packs three code points of 21 bits, blank 0 before the first and none as 0 behind.
BITS = 21
BLANK = 32
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count), sorted by text and n-gram, of lower-cased texts.

    All texts form one array of code points; whatever is no letter becomes a blank, and an n-gram
    lies within one padded word.
    """
    lowered = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    alphabet, code = np.unique(points[letter], return_inverse=True)
    base = len(alphabet) + 2
    symbol = np.ones(len(points) + 2, np.int64)  # 0: none, 1: blank, from 2: letters in order
    symbol[1:-1][letter] = code + 2
    owner = np.repeat(np.arange(len(texts)), lengths)
    a, b, c = symbol[:-2], symbol[1:-1], symbol[2:]
    here = b > 1
    ends = here & (c == 1)
    # A letter's n-grams: itself, the pair and triple around it, and at a word's end the pair after it.
    span = base**3
    keys = np.concatenate(
        [
            owner[here] * span + b[here] * base * base,
            owner[here] * span + (a * base + b)[here] * base,
            owner[ends] * span + (b * base + c)[ends] * base,
            owner[here] * span + ((a * base + b) * base + c)[here],
        ]
    )
    keys, counts = np.unique(keys, return_counts=True)
    who, gram = keys // span, keys % span
    points_of = np.concatenate([[0, BLANK], alphabet.astype(np.int64)])
    packed = points_of[gram // (base * base)] << 2 * BITS | points_of[gram // base % base] << BITS | points_of[gram % base]
    return who, packed, counts


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= TEXTS or size + len(t) > CHARACTERS):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def learn(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, gram, rank) of every language's profile, from all rows with a text and language.

    Counts of all n-grams are summed over all rows; ranks go from 0 by count, ties by n-gram.  Every
    language is kept.  Null and empty texts and null languages teach nothing; repeated rows count each;
    an empty table gives no profile; whole texts are counted, and other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in _chunks(texts):
                names, number = np.unique(np.array(langs[start:stop], dtype=object).astype(str), return_inverse=True)
                who, gram, n = _grams(texts[start:stop])
                order = np.lexsort((gram, number[who]))
                lang, gram, n = number[who][order], gram[order], n[order]
                first = np.flatnonzero(np.r_[len(lang) > 0, (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])][: len(lang)])
                if len(first):
                    columns = [pa.array(names[lang[first]].tolist(), pa.string()), pa.array(gram[first], pa.int64()), pa.array(np.add.reduceat(n, first), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    rows = spread(documents.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col))
    grams = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    return cut(ranked.select("lang", "gram", (F.col("rank") - 1).alias("rank")))


def profiles(learned: DataFrame) -> list[Profiles]:
    """The profiles in groups of about ``TOGETHER`` languages; each group's rows are what comes to the driver at a time."""
    languages = learned.select("lang").distinct().count()
    groups = max(1, -(-languages // TOGETHER))
    group = F.pmod(F.xxhash64("lang"), F.lit(groups))
    return [Profiles([(r["lang"], r["gram"], r["rank"]) for r in learned.where(group == g).collect()]) for g in range(groups)]


class Profiles:
    """Profiles as a table for each block of languages: known n-grams in order, and each one's rank in every language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = SIZE):
        rows = sorted(rows)
        self.size, self.languages = size, sorted({lang for lang, _, _ in rows})
        number = {lang: k for k, lang in enumerate(self.languages)}
        who = np.array([number[lang] for lang, _, _ in rows], np.int64)
        gram, rank = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(self.languages), LANGUAGES):
            own = (who >= start) & (who < start + LANGUAGES)
            grams = np.unique(gram[own])
            ranks = np.full((len(grams) + 1, min(LANGUAGES, len(self.languages) - start)), -1, np.int32)
            ranks[np.searchsorted(grams, gram[own]), who[own] - start] = rank[own]
            self.blocks.append((grams, ranks))

    def _distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distance of each text to each language, and how many n-grams it was taken over."""
        who, gram, n = _grams(texts)
        order = np.lexsort((gram, -n, who))
        who, gram = who[order], gram[order]
        rank = np.arange(len(who)) - np.searchsorted(who, np.arange(len(texts)))[who]
        top = rank < self.size
        who, gram, rank = who[top], gram[top], rank[top]
        out = np.zeros((len(texts), len(self.languages)))
        for block, (grams, ranks) in enumerate(self.blocks):
            at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
            row = np.where(grams[at] == gram, at, len(grams))
            for k in range(ranks.shape[1]):
                own = ranks[row, k]
                out[:, block * LANGUAGES + k] = np.bincount(who, np.where(own >= 0, np.abs(own - rank), self.size), len(texts))
        return out, np.bincount(who, minlength=len(texts))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, 1 - distance / greatest distance) of each text; ties go to the first language."""
        out: list[tuple[str, float]] = []
        whole = ["" if t is None else t for t in texts]
        for start, stop in _chunks(whole):
            distance, grams = self._distances(whole[start:stop])
            for d, n in zip(distance, grams):
                if not n or not self.languages:
                    out.append((UNKNOWN, 0.0))
                    continue
                k = int(d.argmin())
                out.append((self.languages[k], float(1 - d[k] / (n * self.size))))
        return out


def identify(documents: DataFrame, learned: DataFrame | list[Profiles], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Predict the language of every text from the text alone; a map for each group of languages, no shuffle.

    Returns the columns ``keep`` with ``lang_pred`` and ``score`` (0 to 1), a row for each input row.
    A null text, and one without a letter, such as the empty text, has ``und`` and score 0; so has every
    text if nothing was learned.  Repeated rows get equal predictions; an empty table gives an
    empty result; texts of any length are ranked whole.  Columns of ``keep`` may have any name but those
    of the result's own two.
    """
    groups = profiles(learned) if isinstance(learned, DataFrame) else learned
    kinds = [documents.schema[c].dataType.simpleString() for c in keep]
    names = [f"k{i}" for i in range(len(keep))]
    if text_col in keep:
        text, more, shown = names[keep.index(text_col)], [], ""
    else:
        text, more, shown = "text", [F.col(text_col).alias("text")], "text string, "
    now = spread(documents.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], *more, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))
    for i, group in enumerate(groups):

        def make(batches: Iterator[pa.RecordBatch], group: Profiles = group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = []
                texts, lang, score = (batch.column(c).to_pylist() for c in (text, "lang_pred", "score"))
                for old, new in zip(zip(lang, score), group.predict(texts)):
                    # The nearer one; of two at one distance the first, and none before any language.
                    best.append(old if new[0] == UNKNOWN or (old[0] != UNKNOWN and (-old[1], old[0]) < (-new[1], new[0])) else new)
                out = [*batch.columns[:-2], pa.array([x for x, _ in best], pa.string()), pa.array([x for _, x in best], pa.float64())]
                yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

        schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), f"{shown}lang_pred string, score double"])
        now = now.mapInArrow(make, schema)
        if i + 1 < len(groups):
            now = cut(now)  # one Python worker a task, however many groups
    return now.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "lang_pred", "score")
