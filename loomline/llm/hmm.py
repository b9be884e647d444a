"""Scoring texts with a hidden Markov language model.

A token is a word or the end of the text.  Words fall into a bounded number of classes by their
spelling; a hidden state emits a class, and a class emits its words in proportion to their counts:
P(word | state) = P(class | state) * P(word | class).  The Baum-Welch step counts state
transitions and class emissions in every partition by scaled forward-backward recursion over whole
texts and sums them; their size does not depend on the corpus.  The word counts do, and stay
distributed.

Texts are never shuffled.  One map scores them by the model and looks up the counts of the most
frequent words, whose number is bounded; each text's other words, none of which can be frequent, are
put out as (row, word, n) and meet their counts in a join.

The recursions run over many texts in step, the longest first.  Texts of more than ``LONG`` tokens
are cut into segments instead: the forward recursion is associative, so a segment is the product of
its tokens' transition and emission matrices, and a text's likelihood is the product of its segments'
matrices in order.  Both are exact.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import cut, held_out, spread

STATES = 4
#: Classes of words are 2 ** BITS; one more class holds the end of a text alone.
BITS = 12
#: Words longer than this are counted by their digest, so that no key is longer than 33 bytes.
LONGEST_KEY = 32
#: A key that cannot be a word, as it holds white space: the end of a text.
END = b"\n"
ROUNDS = 3
#: Tokens above which a text is worked on by segments, and tokens of a segment.
LONG, SEGMENT = 4_096, 64
#: Segments that are worked on in step, and bytes of text gathered for it.
LANES, GATHERED = 2048, 1_500_000
REMEMBERED = 250_000
#: Words whose counts every executor gets; any other word is at most one token in so many.
HEAD = 65_536


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case: ``bytes.lower`` and ``bytes.split`` know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _keys(found: list[bytes]) -> list[bytes]:
    """What words are counted by: themselves, or a long one's digest after a byte that no word has."""
    if max(map(len, found), default=0) <= LONGEST_KEY:
        return found
    return [w if len(w) <= LONGEST_KEY else END + hashlib.blake2b(w, digest_size=16).digest() for w in found]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _class_of(key, bits: int):
    """A class from a key: the upper bits of a 32-bit product; for integers and arrays alike."""
    return (key * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - bits


def word_class(word: bytes, bits: int = BITS) -> int:
    """A word's class: words of up to three bytes by themselves, longer ones by their last three bytes.

    Endings put unseen words beside seen ones: with classes by whole words, held-out texts of the
    test tables score 0.24 less a token (log10).
    """
    return _class_of(int.from_bytes(word[-3:], "big") | min(len(word), 4) << 24, bits)


def _word_classes(data: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``data``, class) of every word of some lower-cased texts, found in one array."""
    # Two bytes before the first word, so that the last three bytes of any word exist.
    buffer = np.frombuffer(b"  " + b" ".join([*data, b""]), np.uint8)
    space = _SPACE[buffer]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    length = np.minimum(end - start, 4)
    key = buffer[end - 1].astype(np.int64)
    key |= np.where(length > 1, buffer[end - 2].astype(np.int64) << 8, 0)
    key |= np.where(length > 2, buffer[end - 3].astype(np.int64) << 16, 0)
    limits = np.cumsum([len(d) + 1 for d in data]) + 2
    return np.searchsorted(limits, start, side="right"), _class_of(key | length << 24, bits)


def class_sequences(texts: list[str | None], bits: int = BITS) -> list[np.ndarray]:
    """The classes of each text's words and end: ``word_class`` of ``words``."""
    if not texts:
        return []
    owner, classes = _word_classes([t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts], bits)
    out = np.full(len(classes) + len(texts), 1 << bits, np.int32)
    out[np.arange(len(classes)) + owner] = classes
    return np.split(out, np.cumsum(np.bincount(owner, minlength=len(texts)) + 1)[:-1])


class Model:
    """Start probabilities, transitions and class emissions, as plain arrays."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def initial(states: int = STATES, bits: int = BITS) -> Model:
        """States that tend to stay, told apart by a fixed pseudo-random tilt of their emissions."""
        tilt = np.array([[zlib.crc32(b"%d %d" % (s, c)) for c in range((1 << bits) + 1)] for s in range(states)]) / 2.0**32
        emit = 2 + tilt  # a slight tilt: strong ones settle sooner, but in worse places
        move = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """Expected counts, smoothed so that nothing is impossible, made into probabilities."""
        start, move, emit = start + 0.5, move + 0.5, emit + 0.01
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


class Lanes:
    """Class sequences side by side, the longest first: at step t the first ``active[t]`` have a token.

    Tokens lie step after step, so what a step works on is one slice; ``at[t]`` is where it starts.
    """

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        lane = np.empty(len(sizes), np.int64)
        lane[self.order] = np.arange(len(sizes))
        self.active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max()), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = self.at[step] + np.repeat(lane, sizes)
        self.codes = np.empty(len(place), np.int32)
        self.codes[place] = np.concatenate(sequences)
        self.steps = [*zip(self.at[:-1].tolist(), self.active.tolist())]

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(emissions, forward vectors scaled to sum to 1, scales) of every token."""
        emitted = model.emit.T[self.codes]
        alpha, scale = np.empty_like(emitted), np.empty(len(emitted))
        before = 0
        for t, (now, n) in enumerate(self.steps):
            a = alpha[now : now + n]
            if t:
                np.matmul(alpha[before : before + n], model.move, out=a)
                a *= emitted[now : now + n]
            else:
                np.multiply(emitted[:n], model.start, out=a)
            s = a.sum(1, out=scale[now : now + n])
            a /= s[:, None]
            before = now
        return emitted, alpha, scale

    def log_likelihoods(self, model: Model) -> np.ndarray:
        _, _, scale = self.forward(model)
        lane = np.arange(len(scale)) - np.repeat(self.at[:-1], self.active)
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(lane, np.log(scale), len(out))
        return out

    def expected_counts(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, transitions and emissions; backward vectors are scaled as the forward ones are."""
        emitted, alpha, scale = self.forward(model)
        emitted /= scale[:, None]
        beta, weighted = np.ones_like(emitted), emitted  # ``weighted`` takes the place of what is read before
        back = np.ascontiguousarray(model.move.T)
        for t in range(len(self.steps) - 2, -1, -1):
            now, (after, n) = self.steps[t][0], self.steps[t + 1]
            w = weighted[after : after + n]
            w *= beta[after : after + n]
            np.matmul(w, back, out=beta[now : now + n])
        first = self.steps[0][1]
        # Each later token's own place and the place of the one before it.
        previous = np.arange(first, len(alpha)) - np.repeat(self.active[:-1], self.active[1:])
        moves = alpha[previous].T @ weighted[first:] * model.move
        alpha *= beta
        emissions = np.stack([np.bincount(self.codes, alpha[:, k], model.emit.shape[1]) for k in range(len(model.start))])
        return alpha[:first].sum(0), moves, emissions


class Segments:
    """The class sequences of some texts, cut into segments of equal length and padded.

    ``codes`` is (segments, SEGMENT) with -1 where padded, ``owner`` each segment's text and
    ``first`` each text's first segment.
    """

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        parts = -(-sizes // SEGMENT)
        self.first = np.concatenate([[0], np.cumsum(parts)])
        self.owner = np.repeat(np.arange(len(sequences)), parts)
        codes = np.full(self.first[-1] * SEGMENT, -1, np.int32)
        place = np.arange(sizes.sum()) + np.repeat(self.first[:-1] * SEGMENT - (np.cumsum(sizes) - sizes), sizes)
        codes[place] = np.concatenate(sequences)
        self.codes = codes.reshape(-1, SEGMENT)
        self.opens = np.zeros(len(self.codes), bool)
        self.opens[self.first[:-1]] = True

    def products(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Each segment's product of (transition, emission) matrices, scaled, and the scales' logarithms.

        A text's first token has the start probabilities in place of a transition, from any state.
        """
        n, s = len(self.codes), len(model.start)
        emit = np.vstack([model.emit.T, np.ones(s)])
        out, logs = np.empty((n, s, s)), np.zeros(n)
        for at in range(0, n, LANES):
            codes = np.ascontiguousarray(self.codes[at : at + LANES].T)
            emitted = emit[codes]  # by place in the segment, then segment
            m = np.where(self.opens[at : at + LANES, None, None], model.start, model.move) * emitted[0][:, None, :]
            log = np.zeros(codes.shape[1])
            for t in range(1, SEGMENT):
                live = codes[t] >= 0
                if not live.any():
                    break
                step = (m.reshape(-1, s) @ model.move).reshape(-1, s, s)
                step *= emitted[t][:, None, :]
                if t % 8 == 7:
                    scale = np.where(live, step.max(axis=(1, 2)), 1.0)
                    log += np.log(scale)
                    step /= scale[:, None, None]
                m = step if live.all() else np.where(live[:, None, None], step, m)
            scale = m.max(axis=(1, 2))
            out[at : at + LANES], logs[at : at + LANES] = m / scale[:, None, None], log + np.log(scale)
        return out, logs

    def _steps(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(texts, segments) for the first segment of every text, then the second, and so on."""
        count = np.diff(self.first)
        texts = np.arange(len(count))
        for k in range(count.max(initial=0)):
            texts = texts[count[texts] > k]
            yield texts, self.first[texts] + k

    def entries(self, model: Model, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward vectors before each segment, scaled to sum to 1, and each text's logarithm of scales."""
        texts, s = len(self.first) - 1, len(model.start)
        vector = np.full((texts, s), 1.0 / s)  # any that sums to 1: the first token does not depend on it
        entry, log = np.empty((len(self.codes), s)), np.zeros(texts)
        for who, segment in self._steps():
            entry[segment] = vector[who]
            v = np.einsum("ni,nij->nj", vector[who], products[segment])
            scale = v.sum(1)
            log[who] += np.log(scale)
            vector[who] = v / scale[:, None]
        return entry, log

    def exits(self, model: Model, products: np.ndarray) -> np.ndarray:
        """Backward vectors after each segment, scaled to sum to 1."""
        s = len(model.start)
        out = np.full((len(self.codes), s), 1.0 / s)
        for who, segment in reversed([*self._steps()]):
            more = who[self.first[who] < segment]
            if len(more):
                at = segment[self.first[who] < segment]
                v = np.einsum("nij,nj->ni", products[at], out[at])
                out[at - 1] = v / v.sum(1, keepdims=True)
        return out

    def log_likelihoods(self, model: Model) -> np.ndarray:
        products, logs = self.products(model)
        _, log = self.entries(model, products)
        return log + np.bincount(self.owner, logs, len(log))

    def expected_counts(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, transitions and emissions."""
        products, _ = self.products(model)
        entry, exit_ = self.entries(model, products)[0], self.exits(model, products)
        s = len(model.start)
        emit = np.vstack([model.emit.T, np.ones(s)])
        starts, moves, emissions = np.zeros(s), np.zeros((s, s)), np.zeros((model.emit.shape[1] + 1, s))
        for at in range(0, len(self.codes), LANES):
            codes, opens = np.ascontiguousarray(self.codes[at : at + LANES].T), self.opens[at : at + LANES]
            emitted, living = emit[codes], codes >= 0
            full = living.all(1)
            alphas = np.empty((SEGMENT + 1, codes.shape[1], s))
            alphas[0] = entry[at : at + LANES]
            for t in range(SEGMENT):
                a = np.matmul(alphas[t], model.move, out=alphas[t + 1])
                if t == 0:
                    a[opens] = model.start
                a *= emitted[t]
                a /= a.sum(1, keepdims=True)
                if not full[t]:
                    alphas[t + 1] = np.where(living[t][:, None], a, alphas[t])
            beta = exit_[at : at + LANES].copy()
            gammas = np.zeros((SEGMENT, codes.shape[1], s))
            for t in range(SEGMENT - 1, -1, -1):
                live = living[t]
                if not live.any():
                    continue
                gamma = np.multiply(alphas[t + 1], beta, out=gammas[t])
                gamma /= gamma.sum(1, keepdims=True)
                if not full[t]:
                    gamma[~live] = 0
                weighted = beta * emitted[t]
                back = weighted @ model.move.T
                inner = live
                if t == 0:
                    starts += gamma[opens].sum(0)
                    inner = live & ~opens
                # Expected moves: the forward vector times what follows, over the mass of both.
                mass = (alphas[t] * back).sum(1)
                share = np.divide(1.0, mass, out=np.zeros_like(mass), where=inner)
                moves += (alphas[t] * share[:, None]).T @ weighted * model.move
                back /= back.sum(1, keepdims=True)
                beta = back if full[t] else np.where(live[:, None], back, beta)
            flat = codes.ravel() % len(emit)
            for k in range(s):
                emissions[:, k] += np.bincount(flat, gammas[:, :, k].ravel(), len(emit))
        return starts, moves, emissions[:-1].T


def _by_length(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, Lanes | Segments]]:
    """(places, sequences) of the long ones and of the others, each in the form that suits them."""
    long = np.array([len(s) > LONG for s in sequences], bool)
    for form, own in ((Lanes, np.flatnonzero(~long)), (Segments, np.flatnonzero(long))):
        if len(own):
            yield own, form([sequences[i] for i in own])


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the probability of each class sequence: the scaled forward recursion."""
    out = np.zeros(len(sequences))
    for own, some in _by_length(sequences):
        out[own] = some.log_likelihoods(model)
    return out


def expected_counts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, transitions and emissions, summed over the sequences."""
    total = np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit)
    for _, some in _by_length(sequences):
        for sum_, part in zip(total, some.expected_counts(model)):
            sum_ += part
    return total


def _gathered(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``GATHERED`` bytes."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        size += n
        if size >= GATHERED:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train(documents: DataFrame, text_col: str = "text", rounds: int = ROUNDS, states: int = STATES, bits: int = BITS) -> Model:
    """Baum-Welch over all rows: each round sums every partition's expected counts.

    A round brings a row for each class and state to the driver, whatever the input.  Null and empty
    texts are their end alone; repeated rows count each; an empty table leaves the model smoothed only.
    """
    model, classes = Model.initial(states, bits), (1 << bits) + 1
    columns = [f"v{k}" for k in range(states)]
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros((classes + states + 1, states))
            for batch in batches:
                texts = batch.column(0)
                for a, b in _gathered(texts):
                    starts, moves, emissions = expected_counts(model, class_sequences(texts.slice(a, b - a).to_pylist(), bits))
                    total += np.vstack([emissions.T, moves, starts])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *(pa.array(total[:, k]) for k in range(states))], names=["row", *columns])

        counted = documents.select(text_col).mapInArrow(count, "row int, " + ", ".join(f"{c} double" for c in columns))
        total = np.zeros((classes + states + 1, states))
        for row in counted.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).collect():
            total[row["row"]] = [row[c] for c in columns]
        model = Model.from_counts(total[-1], total[classes:-1], total[:classes].T)
    return model


def count_words(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """(word, class, c, n): how often each word and the end of a text occur in the training rows and in all.

    ``documents`` has ``text`` and ``held_out``; rows of one task are counted together before the shuffle.
    """

    def packed(every: Counter[bytes], held: Counter[bytes]) -> pa.RecordBatch:
        ends = every.pop(END, 0)
        whole = [*every]
        n = np.fromiter(every.values(), np.int64, len(whole))
        c = n - np.fromiter(map(held.get, whole, repeat(0)), np.int64, len(whole))
        columns = [pa.array(_keys(whole) + [END], pa.binary()), pa.array(np.append(_word_classes(whole, bits)[1], 1 << bits).astype(np.int32))]
        columns += [pa.array(np.append(c, ends - held[END])), pa.array(np.append(n, ends))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "class", "c", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text, out in zip(batch.column("text"), batch.column("held_out").to_pylist()):
                found = words(text.as_py())
                found.append(END)
                every.update(found)
                if out:
                    held.update(found)
                if len(every) > REMEMBERED:
                    yield packed(every, held)
                    every, held = Counter(), Counter()
        yield packed(every, held)

    counted = documents.select("text", "held_out").mapInArrow(count, "word binary, class int, c long, n long")
    return counted.groupBy("word", "class").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _head(counts: DataFrame) -> dict[bytes, int]:
    """The most frequent words of all rows and their counts in the training rows; ``HEAD`` of them at most.

    The least count that keeps them so few is found from the number of words in each eighth of an octave.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = sorted(((r["step"], r["words"]) for r in counts.where("n > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, total = None, 0
    for at, number in sizes:
        total += number
        if total > HEAD:
            break
        least = at
    if least is None:
        return {}
    return {bytes(r["word"]): r["c"] for r in counts.where(step >= least).select("word", "c").collect()}


def score_documents(
    documents: DataFrame, folds: int = 5, fold: int = 1, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, bits: int = BITS
) -> DataFrame:
    """Learn from the rows outside the fold and score every whole text.

    Returns ``id_col``, ``held_out`` (crc32 of the id as text mod ``folds`` is ``fold``), ``n_tokens`` (words and
    one end), ``n_known`` (tokens that occur in the training rows), ``train_tokens``, ``base_score``
    (log10 probability by smoothed token counts) and ``score`` (by the model), for every input row.
    ``states`` and ``bits`` are the model's hidden states and the logarithm of its word classes.

    A null or empty text is its end alone.  Rows with a null id are training rows.  Repeated rows
    each count and get equal scores; rows are told apart by a key of their own, so null and repeated ids
    are no hot keys; without training rows all counts are 0; an empty table gives an empty result; texts
    of any length are scored whole; other columns are not read, whatever their names.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    rows = spread(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col, folds, fold).alias("held_out")))
    model = train(rows.where(~F.col("held_out")), "text", rounds, states, bits)
    counts = cut(count_words(rows, bits))
    classes = (1 << bits) + 1
    class_n, class_v = np.zeros(classes), np.zeros(classes)
    for row in counts.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).collect():
        class_n[row["class"]], class_v[row["class"]] = row["n"], row["v"]
    all_n, all_v = int(class_n.sum()), int(class_v.sum())
    head = _head(counts) | {END: int(class_n[-1])}
    # Each token's score is log10(c + 0.5) less one of these.
    base_less, inside_less = np.log10(all_n + 0.5 * (all_v + 1)), np.log10(class_n + 0.5 * (class_v + 1))

    def look_up(texts: list[str | None]) -> tuple[list, ...]:
        sequences, n = class_sequences(texts, bits), []
        whole: list[bytes] = []
        for text in texts:
            found = words(text)
            n.append(len(found) + 1)
            whole += _keys(found)
            whole.append(END)
        owner = np.repeat(np.arange(len(texts)), n)
        # -1: not in the head, to be looked up by the join.
        c = np.fromiter(map(head.get, whole, repeat(-1)), np.float64, len(whole))
        there = c >= 0
        logs = np.bincount(owner, np.where(there, np.log10(np.maximum(c, 0) + 0.5), 0), len(texts))
        known = np.bincount(owner, c > 0, len(texts)).astype(np.int64)
        model_part = log_likelihoods(model, sequences) / np.log(10) - np.bincount(owner, inside_less[np.concatenate(sequences)], len(texts))
        rest: list[dict] = [{} for _ in texts]
        at = np.flatnonzero(~there)
        for i, k in zip(at.tolist(), owner[at].tolist()):
            own, w = rest[k], whole[i]
            own[w] = own.get(w, 0) + 1
        return n, known.tolist(), logs.tolist(), model_part.tolist(), rest

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _gathered(batch.column("text")):
                part = batch.slice(a, b - a)
                n, known, logs, model_part, rest = look_up(part.column("text").to_pylist())
                offsets = pa.array(np.cumsum([0, *map(len, rest)]), pa.int32())
                keys = pa.ListArray.from_arrays(offsets, pa.array([w for own in rest for w in own], pa.binary()))
                times = pa.ListArray.from_arrays(offsets, pa.array([k for own in rest for k in own.values()], pa.int32()))
                columns = [part.column("id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(model_part, pa.float64()), keys, times]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "known", "logs", "model", "words", "times"])

    mapped = rows.mapInArrow(score, f"id {id_type}, held_out boolean, n_tokens long, known long, logs double, model double, words array<binary>, times array<int>")
    # Once written, row numbers stay.
    scored = cut(mapped.withColumn("row", F.monotonically_increasing_id()))
    rest = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
    found = rest.join(counts.select("word", "c"), "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    more = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("more_logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    joined = scored.drop("words", "times").join(more, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(all_n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(base_less))).alias("base_score"), (logs + F.col("model")).alias("score"),
    )
